"""Language ID by compression."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stimframe.llm.common import without

#: A language is learned from a sample: the first SAMPLE_DOCS distinct training texts by their hash, of which whole texts of DICT_CHARS characters together at most are taken.
DICT_CHARS, SAMPLE_DOCS = 1 << 17, 128
#: Hashes are ranked in so many parts of a language first.
PARTS = 64
#: How hard zstandard looks for matches, for texts of every size.
LEVEL = 9
#: Texts are compressed in blocks of so many bytes, each against the dictionary alone: a long text does not come to predict itself.
BLOCK_BYTES = 2048
#: Margins under this share of the smallest size are narrow.
NARROW = 0.01
_OTHER = re.compile(r"[\W\d_]+")
ADDED = ("lang_pred", "score", "narrow")


def learn_dictionaries(train: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Raw-content dictionary of each non-null language, from whole texts of its sample.

    Equal texts count once, however many copies there are. Hashes alone are made distinct and ranked; Spark keeps the first
    SAMPLE_DOCS within each task before it shuffles, so a language with most rows makes no large group. In the order of
    the hash, each text that still fits in DICT_CHARS is taken whole and the others are passed over; if none fits, the
    shortest is taken. Only those texts come to the driver. The languages come by their number of texts, most first; an empty table gives none.
    """
    texts = train.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    every = texts.select("lang", "h", F.length("text").alias("size")).distinct()
    for keys in (["lang", F.pmod("h", F.lit(PARTS))], ["lang"]):  # first within parts of a language, so that few of its rows meet
        every = every.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("h", "size"))).where(F.col("r") <= SAMPLE_DOCS)
    ranks = every
    taken: dict[str, list[tuple[int, int, int]]] = {}
    sample: dict[str, list[tuple[int, int, int]]] = {}
    for row in ranks.orderBy("lang", "r").collect():
        sample.setdefault(row.lang, []).append((row.r, row.h, row["size"]))
    for lang, rows in sample.items():
        room, held = DICT_CHARS, []
        for row in rows:
            if row[2] <= room:
                room -= row[2]
                held.append(row)
        taken[lang] = held or [min(rows, key=lambda x: (x[2], x[0]))]
    spark = train.sparkSession
    chosen = spark.createDataFrame([(lang, *row) for lang, rows in taken.items() for row in rows], "lang string, r int, h long, size int")
    first = texts.withColumn("size", F.length("text")).join(F.broadcast(chosen), ["lang", "h", "size"]).groupBy("lang", "r").agg(F.min("text").alias("text")).orderBy("lang", "r").collect()
    found: dict[str, list[bytes]] = {}
    for row in first:
        found.setdefault(row.lang, []).append(_fold(row.text))
    often = {r.lang: r.n for r in train.where(F.col(lang_col).isin(list(found))).groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    return {lang: b"".join(found[lang]) for lang in sorted(found, key=lambda x: (-often.get(x, 0), x))}


def _fold(text: str) -> bytes:
    """Lower-case words between single spaces: capitals, punctuation and digits say little of the language."""
    return f" {_OTHER.sub(' ', text.lower()).strip()} ".encode()


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", narrow: float = NARROW) -> DataFrame:
    """docs with lang_pred, score (0 to 1) and narrow.

    The whole text is compressed with each language's dictionary; lang_pred is that of the smallest size, `und` for a null
    text or one without letters, or if there are no dictionaries. score is the weight of that language when a byte saved
    counts as so many bits, softened by the text's length. narrow rejects: the runner-up is within that share of the smallest
    size. Ties go to the more common language; repeated rows get equal results; an empty table gives an empty result. Columns with an added name are replaced. No shuffle.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(dictionaries)  # about DICT_CHARS characters for each language

    @F.pandas_udf("lang_pred string, score double, narrow boolean")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = list(held.value)
        compressors = [_compressor(d) for d in held.value.values()]
        for texts in parts:
            yield pd.DataFrame([_choose(t, names, compressors, narrow) for t in texts], columns=["lang_pred", "score", "narrow"])

    rows = without(docs, [*ADDED, "__r"])
    return rows.withColumn("__r", run(F.col(text_col))).select("*", "__r.lang_pred", "__r.score", "__r.narrow").drop("__r")


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False)


def _choose(text: str | None, names: list[str], compressors: list, narrow: float) -> tuple[str, float, bool]:
    if not text or not names or not any(map(str.isalpha, text)):
        return "und", 0.0, True
    data = _fold(text)
    blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
    sizes = [sum(len(c.compress(b)) for b in blocks) for c in compressors]
    least = min(sizes)
    best = sizes.index(least)
    weights = [math.exp(-(s - least) * 8 / math.sqrt(len(data))) for s in sizes]
    second = min((s for i, s in enumerate(sizes) if i != best), default=2 * least)
    return names[best], 1 / sum(weights), second - least < narrow * least


def held_out(id_col: str, mod: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves that remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % mod == rest, F.lit(False))
