"""Language identification by compression: the language whose dictionary makes a text smallest."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.common import slices

#: bounds of what is learned: rows and characters of a row taken for a language, and its dictionaries
SAMPLE_ROWS, SAMPLE_CHARS, DICTIONARIES, DICTIONARY_BYTES = 400, 2000, 2, 112_000
#: a text is compressed in pieces of so many bytes, since a long text becomes its own dictionary
PIECE_BYTES = 2048
#: a text whose best and second language differ by less than this share of the second's size is rejected
MARGIN = 0.001
#: below this margin the further dictionaries are asked too, at a higher level
UNSURE, LEVEL, UNSURE_LEVEL = 0.06, 5, 9


@dataclass
class Model:
    """Raw-content dictionaries by language."""

    dictionaries: dict[str, list[bytes]]
    _ready: dict = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return {"dictionaries": self.dictionaries, "_ready": {}}

    @property
    def languages(self) -> list[str]:
        return sorted(self.dictionaries)

    def _compressor(self, language: str, k: int, level: int) -> zstd.ZstdCompressor:
        if (language, k, level) not in self._ready:
            content = self.dictionaries[language][k]
            d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            params = zstd.ZstdCompressionParameters.from_level(level, dict_size=len(content), source_size=PIECE_BYTES, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstd.FORMAT_ZSTD1_MAGICLESS)
            d.precompute_compress(compression_params=params)
            self._ready[language, k, level] = zstd.ZstdCompressor(compression_params=params, dict_data=d)
        return self._ready[language, k, level]

    def _sizes(self, pieces: list[bytes], k: int, level: int) -> np.ndarray:
        out = []
        for language in self.languages:
            compress = self._compressor(language, min(k, len(self.dictionaries[language]) - 1), level).compress
            out.append(sum([len(compress(p)) for p in pieces]))
        return np.array(out, dtype=float)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and margin of a whole text."""
        names = self.languages
        if not names or text is None or not any(map(str.isalpha, text)):
            return "und", 0.0
        if len(names) == 1:
            return names[0], 1.0
        data = normal(text)
        pieces = [data[i : i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES)]
        sizes = self._sizes(pieces, 0, LEVEL)
        first, second = np.sort(sizes)[:2]
        if second - first < UNSURE * second:
            for k in range(max(map(len, self.dictionaries.values()))):
                sizes += self._sizes(pieces, k, UNSURE_LEVEL)
            first, second = np.sort(sizes)[:2]
        return names[int(np.argmin(sizes))], float((second - first) / second)


def normal(text: str) -> bytes:
    """Lower case, runs of all but letters as one space: what tells languages apart."""
    return (" " + " ".join(_WORD.findall(text.lower())) + " ").encode()


_WORD = re.compile(r"[^\W\d_]+")


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS, dictionaries: int = DICTIONARIES, dictionary_bytes: int = DICTIONARY_BYTES) -> Model:
    """Dictionaries from at most sample_rows x sample_chars of each language, chosen by the hash of the text.

    Rows without language or letters teach nothing, and copies of a text count once. A task passes on each text's hash once and at
    most sample_rows a language, so a common language or text is no hot task. No rows give a model without languages, which predicts `und` for all.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).cast("string").alias("lang"), F.xxhash64(text).alias("h"), F.col(text).alias("text")).withColumn("piece", F.substring("text", 1, sample_chars)).drop("text")
    first = rows.select("lang", "h").distinct().withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= sample_rows)
    chosen = rows.join(F.broadcast(first), ["lang", "h"]).groupBy("lang", "r").agg(F.min("piece").alias("piece"))  # bounded: sample_rows a language
    made: dict[str, list[list[bytes]]] = {}
    for r in sorted(chosen.collect(), key=lambda r: (r["lang"], r["r"])):  # bounded: sample_rows x sample_chars a language
        parts = made.setdefault(r["lang"], [[] for _ in range(dictionaries)])
        parts[(r["r"] - 1) % dictionaries].append(normal(r["piece"]))
    return Model({k: [b"".join(p)[:dictionary_bytes] for p in parts if p] for k, parts in made.items()})


def identify(docs: DataFrame, model: Model, text: str = "text", margin: float = MARGIN) -> DataFrame:
    """docs with lang_pred, score (0 to 1) and rejected; columns of these names are replaced.

    score is the share by which the best language undercuts the second; with one language it is 1. A text is rejected when score
    is below `margin`. A null text, or one without letters (Unicode's; no numbers like ½ or Ⅷ), is `und` with score 0 and rejected. Equal sizes go to the language
    first in order, with score 0. Whole texts are compressed, however long; every row stays.
    """
    send = docs.sparkSession.sparkContext.broadcast(model)  # bounded by fit
    schema = docs.drop("lang_pred", "score", "rejected").schema
    columns = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = send.value
        for batch in slices(batches):
            pred, score = [], []
            for t in batch.column(columns.index(text)).to_pylist():
                language, by = m.predict(t)
                pred.append(language)
                score.append(by)
            s = np.array(score, dtype=float)
            more = [pa.array(pred, pa.string()), pa.array(s, pa.float64()), pa.array((s < margin) | (np.array(pred, dtype=object) == "und"), pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*columns, "lang_pred", "score", "rejected"])

    out = T.StructType([*schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return docs.select(*columns).mapInArrow(run, out)
