"""Language identification by compression.

For each language a zstandard raw-content dictionary is made of text in that
language.  A text is encoded once with every dictionary; the language whose
dictionary gives the fewest bytes wins, and a narrow margin is a rejection.  A
text is encoded in blocks, so that its own earlier words do not take the place
of the dictionary: whole texts count, of any length, in bounded memory.  Where the
margin is narrow, as in the shortest texts, the text is encoded once more by a
more thorough compressor and both sizes count.

Before encoding, letters are lower-cased and every run of other characters
becomes one space: case, digits and markup say nothing about the language.

Fitting takes a bounded sample: of each language ``pieces`` labelled rows, those
with the smallest hash of their id in each of ``SALTS`` classes, and of each one
a stretch of ``piece_chars`` characters at a place given by the hash; at most
``dict_bytes`` a language.
Rows whose crc32(id as text) mod 4 is 2 are never learned from.

Edge cases: a text that is null or has no letter is ``und`` with score 0 and
rejected; equal sizes go to the language first by name, with score 0; without
any labelled row every text is ``und``; more than ``MAX_LANGUAGES`` (1000)
languages among the labelled rows raise ValueError, because every language
costs a dictionary of up to ``dict_bytes`` (110 KB) on the driver and in each
worker; an empty table gives an empty result; other columns are kept or ignored, never read.
"""

from __future__ import annotations

import re
from typing import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from reclaim.llm.common import held_out, text_of

DICT_BYTES, PIECES, PIECE_CHARS, SALTS = 110_000, 640, 300, 64
BLOCK_BYTES, LEVEL, FINE_LEVEL = 4096, 5, 12
#: More languages than this in the labels is taken for a mistake.
MAX_LANGUAGES = 1000
#: Least relative margin, (second - best) / second, of an accepted text.
MIN_MARGIN = 0.004
UNKNOWN = "und"

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> str:
    return _NOT_LETTERS.sub(" ", text.lower()).strip() if text else ""


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          dict_bytes: int = DICT_BYTES, pieces: int = PIECES, piece_chars: int = PIECE_CHARS) -> dict[str, bytes]:
    """Language -> dictionary content."""
    lang, text = F.col(f"`{lang_col}`").cast("string"), text_of(text_col)
    mark = F.xxhash64(F.col(f"`{id_col}`").cast("string"), F.lit("piece"))
    rows = docs.filter(lang.isNotNull() & ~held_out(id_col)).select(
        lang.alias("lang"), mark.alias("mark"),
        F.substring(text, (F.pmod(mark, F.greatest(F.length(text) - piece_chars, F.lit(1))) + 1).cast("int"),
                    F.lit(piece_chars)).alias("piece"))
    # the first few of each of SALTS classes: no task meets more of a language
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("mark"), F.lit(SALTS)))
    nth = F.row_number().over(Window.partitionBy("lang", "salt").orderBy("mark", "piece"))
    taken = rows.withColumn("nth", nth).filter(F.col("nth") <= max(1, pieces // SALTS)).select("lang", "mark", "piece")
    languages = [r[0] for r in taken.select("lang").distinct().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()]
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages in the labels")
    found: dict[str, list[str]] = {x: [] for x in languages}
    for r in taken.orderBy("lang", "mark", "piece").collect():
        found[r["lang"]].append(letters(r["piece"]))
    # an empty dictionary is not allowed, and a language without letters can't be learned
    return {k: d for k, v in found.items() if (d := " ".join(v).encode()[:dict_bytes].strip())}


class Encoder:
    """Two compressors for each language: a fast one, and a thorough one for
    texts that the fast one leaves undecided."""

    def __init__(self, content: dict[str, bytes], level: int = LEVEL, fine_level: int = FINE_LEVEL):
        self.names = sorted(content)
        self.fast, self.fine = ([self._compressor(content[n], x) for n in self.names] for x in (level, fine_level))

    @staticmethod
    def _compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False,
                                        write_dict_id=False)

    def classify(self, text: str | None, block: int = BLOCK_BYTES, narrow: float = MIN_MARGIN) -> tuple[str, float]:
        """The language and the relative margin over the second; where that is
        narrow, of the sizes by both compressors together."""
        plain = letters(text)
        if not self.names or not any(map(str.isalpha, plain)):
            return UNKNOWN, 0.0
        data = plain.encode("utf-8", "replace")
        parts = [data[a:a + block] for a in range(0, len(data), block)]
        total = [0] * len(self.names)
        for compressors in (self.fast, self.fine):
            total = [n + sum(len(c.compress(p)) for p in parts) for n, c in zip(total, compressors)]
            best = min(range(len(total)), key=total.__getitem__)
            rest = min((n for i, n in enumerate(total) if i != best), default=2 * total[best])
            margin = (rest - total[best]) / rest
            if margin >= narrow:
                break
        return self.names[best], margin


def identify(docs: DataFrame, content: dict[str, bytes], text_col: str = "text", min_margin: float = MIN_MARGIN,
             prefix: str = "") -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1, from the margin) and rejected;
    ``prefix`` is put before these names, and they replace columns so named."""
    @pandas_udf("lang string, margin double")
    def classify(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(content)
        for t in texts:
            yield pd.DataFrame([encoder.classify(x) for x in t], columns=["lang", "margin"])

    out = docs.withColumn("_language", classify(F.col(f"`{text_col}`").cast("string")))
    lang, margin = F.col("_language.lang"), F.col("_language.margin")
    return (out.withColumn(f"{prefix}lang_pred", lang)
            .withColumn(f"{prefix}score", margin / (margin + F.lit(0.02)))
            .withColumn(f"{prefix}rejected", (lang == UNKNOWN) | (margin < min_margin))
            .drop("_language"))


def keep_identified(docs: DataFrame, content: dict[str, bytes], text_col: str = "text",
                    min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows whose language is clear, with the columns they came with."""
    names = docs.columns
    return (identify(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"),
                                 F.col(f"`{text_col}`").alias("text")), content, "text", min_margin)
            .filter(~F.col("rejected")).select("_row.*"))
