"""Language identification by compression: the language whose raw-content dictionary makes the text smallest.

Each language has a zstandard dictionary of plain sample text.  A text's cost in a language is the number of bytes that
its compressed form takes, in lower case, with that dictionary; a margin between the two cheapest that is narrower than REJECT, as a share
of the second, is marked as rejected.

Defined cases: a null text, or one without a letter, is "und" with score 0; so is every text if no language was
learned; with one language, its score is 1; ties go to the language that sorts first; a null id stays null and is learned from; repeated rows
each get a row, but count once where a sample is drawn; very long texts are compressed whole; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwell.llm.common import held_out, slices, table, text_key, uniform

#: Learning takes about this many rows of each language, more where they are short, and at most this many bytes for its dictionary.
FIT_ROWS, DICTIONARY_BYTES = 300, 110_000
#: All dictionaries have as many bytes as the smallest, but for languages that have less than this.
LEAST_BYTES = 20_000
#: The lowest level whose accuracy is within a standard error of the best one's when one half of check_s's learning rows
#: is judged by dictionaries of the other half; held-out rows had no part in it.
LEVEL, REJECT, UNDETERMINED = 9, 0.02, "und"


def level(lengths: list[int], size: int) -> int:
    """The shortest span for which the texts together give `size` bytes, or the longest text where they don't."""
    left = sorted(lengths)
    for i, n in enumerate(left):
        if n * (len(left) - i) >= size:
            return -(-size // (len(left) - i))
        size -= n
    return left[-1] if left else 0


def whole_words(text: bytes, n: int) -> bytes:
    """The beginning of at most n bytes, up to a space, or to a character where no space is near."""
    if len(text) <= n:
        return text
    head = text[:n].rpartition(b" ")[0]
    return head if 2 * len(head) >= n else text[:n].decode(errors="ignore").encode()


def learn(docs: DataFrame, rows: int = FIT_ROWS, size: int = DICTIONARY_BYTES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", seed: int = 31) -> dict[str, bytes]:
    """Language to dictionary, from a uniform sample of bounded size for each language outside the held-out fold.

    A sample has about `rows` texts, or more where those are too short to fill the dictionary.  It is drawn by id and text, so
    rows with the same id, or none, are drawn each by itself, and rows that repeat another are one.  Each gives a span of whole
    words from anywhere in it, as long as the language's texts need to fill the dictionary together.  All are then cut to
    the size of the smallest, or to LEAST_BYTES if that is less.
    """
    lang, text = F.col(lang_col).cast("string"), F.col(text_col)
    known = docs.where(lang.isNotNull() & text.isNotNull() & ~held_out(id_col)).select(lang.alias("__l"), text.alias("__t"), text_key(id_col, text_col).alias("__h"))
    # for each language how many different rows, about, and their bytes
    sums = known.groupBy("__l").agg(F.approx_count_distinct("__h", 0.03), F.avg(F.octet_length("__t"))).collect()
    counts = {r[0]: (r[1], r[1] * r[2]) for r in sums}
    if not counts:
        return {}
    spark = docs.sparkSession
    rate = spark.createDataFrame([(k, min(1.0, max(rows / n, 1.5 * size / max(b, 1)))) for k, (n, b) in counts.items()], "__l string, __rate double")
    picked = known.join(F.broadcast(rate), "__l").where(uniform(seed, "__h") < F.col("__rate"))
    lengths: dict[str, list[int]] = {}
    for r in picked.groupBy("__l", "__h").agg(F.first(F.octet_length("__t"))).drop("__h").collect():
        lengths.setdefault(r[0], []).append(r[1])
    # a little more than the size, for the parts of words that go
    spans = {k: level(v, size + size // 8) for k, v in lengths.items()}
    most = spark.createDataFrame(list(spans.items()), "__k string, __most int")
    start = F.pmod(F.xxhash64("__h", F.lit(seed + 1)), F.greatest(F.length("__t") - F.col("__most"), F.lit(0)) + 1).cast("int") + 1
    spanned = picked.join(F.broadcast(most), F.col("__l") == F.col("__k")).select("__l", "__h", F.substring("__t", start, F.col("__most")).alias("t"))
    sample = spanned.groupBy("__l", "__h").agg(F.first("t")).collect()
    out: dict[str, bytes] = {}
    for k in sorted(counts):
        texts = [r[2].lower().encode() for r in sorted((r for r in sample if r[0] == k), key=lambda r: (r[1], r[2]))]
        content = b"\n".join(whole_words(t, spans[k]) for t in texts)
        if content:
            out[k] = content[:size]
    # a larger dictionary makes texts of any language smaller, so that sizes must not differ
    common = max(LEAST_BYTES, min(map(len, out.values()), default=0))
    return {k: v[:common] for k, v in out.items()}


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        import zstandard as z

        self.langs = sorted(dictionaries)
        self.parts = []
        for lang in self.langs:
            d = z.ZstdCompressionDict(dictionaries[lang], dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.parts.append(z.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether the margin is too narrow."""
        if not text or not self.langs or not has_letter(text):
            return UNDETERMINED, 0.0, True
        data = text.lower().encode()
        cost = [len(c.compress(data)) for c in self.parts]
        order = sorted(range(len(cost)), key=lambda i: (cost[i], i))
        best = self.langs[order[0]]
        if len(cost) == 1:
            return best, 1.0, False
        margin = (cost[order[1]] - cost[order[0]]) / cost[order[1]]
        # a margin of REJECT is a score of a half
        return best, margin / (margin + REJECT), margin < REJECT


def identify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score (0 to 1), rejected (narrow margin)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        classifier = Classifier(dictionaries)
        for batch in batches:
            for part in slices(batch, 1):
                found = [classifier.predict(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(zip(*found), (pa.string(), pa.float64(), pa.bool_())))], ["doc_id", "lang_pred", "score", "rejected"])

    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(docs))
