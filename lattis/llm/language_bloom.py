"""Language ID by language-bitmask n-gram filters.

One Bloom filter for each language, bit-sliced: slot ``i`` holds bit ``i`` of
every language's filter in one word; every 64 languages have slots of their
own. An n-gram reads a few slots; their
conjunction is the set of all languages that (may) contain it. Counts by
language, less the expected false positives, decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from lattis.llm.memory import trimmed

SIZE = 4
#: Languages at most: 16 MB of slots for every 64.
MOST = 256
_odd = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def code_points(text: str) -> np.ndarray:
    """The lower-cased text as code points."""
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")


_letter = np.zeros(0x110000, dtype=bool)
_known = np.zeros(0x110000, dtype=bool)


def letters_of(points: np.ndarray) -> np.ndarray:
    """Whether each code point is a letter; each is looked up once a process."""
    if not _known[points].all():
        for p in np.unique(points[~_known[points]]):
            _letter[p] = chr(p).isalpha()
            _known[p] = True
    return _letter[points]


def ngrams(text: str) -> tuple[np.ndarray, bool]:
    """64-bit keys of all ``SIZE``-grams of the whole text; whether it has a letter.

    Runs of other characters count as one space, so n-grams see word ends
    but neither digits nor punctuation.
    """
    points = code_points(text)
    letter = letters_of(points)
    if not letter.any():
        return np.empty(0, np.uint64), False
    points = np.where(letter, points, 32)
    keep = letter | np.r_[True, letter[:-1]]
    points = np.r_[32, points[keep], 32].astype(np.uint64)
    if len(points) < SIZE:
        return np.empty(0, np.uint64), True
    key = np.zeros(len(points) - SIZE + 1, dtype=np.uint64)
    for i, odd in enumerate(_odd):
        key += points[i : len(key) + i] * np.uint64(odd)
    key ^= key >> np.uint64(29)
    key *= np.uint64(0xBF58476D1CE4E5B9)
    key ^= key >> np.uint64(32)
    return key, True


@dataclass
class BitSlicedBloom:
    """``slots[i]``: which languages' filters have bit ``i`` set; with over 64 languages ``slots[k, i]``, for the ``k``-th 64 of them."""

    languages: list[str]
    slots: np.ndarray
    false_rate: np.ndarray
    share: np.ndarray
    hashes: int = 3
    usual: int = 0  #: the place of the commonest language

    @staticmethod
    def build(languages: list[str], keys: list[np.ndarray], bits: int = 21, hashes: int = 3) -> BitSlicedBloom:
        if len(languages) > MOST:
            raise ValueError(f"{MOST} languages at most")
        kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if np.dtype(k).itemsize * 8 >= min(64, max(1, len(languages))))
        slots = np.zeros((max(1, -(-len(languages) // 64)), 1 << bits), dtype=kind)
        rates = []
        for i, own in enumerate(keys):
            part, bit = slots[i // 64], kind(i % 64)
            flag = kind(1 << i % 64)
            for at in positions(own, bits, hashes):
                part[at] |= flag
            rates.append((((part >> bit) & kind(1)).mean()) ** hashes)
        return BitSlicedBloom(languages, slots[0] if len(slots) == 1 else slots, np.array(rates), np.ones(len(languages)), hashes)

    def members(self, keys: np.ndarray) -> np.ndarray:
        """All languages whose filter contains each key, as a bitmask (a row of masks for each 64 languages, if over 64)."""
        bits = int(self.slots.shape[-1]).bit_length() - 1
        found = None
        for at in positions(keys, bits, self.hashes):
            found = self.slots[..., at] if found is None else found & self.slots[..., at]
        return found

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Contained n-grams by language, corrected for false positives."""
        mask = self.members(keys)
        # few masks are possible with few languages: count each mask once
        if self.slots.dtype == np.uint8:
            of_mask = np.bincount(mask, minlength=256)
            table = (np.arange(256)[:, None] >> np.arange(len(self.languages))) & 1
            seen = of_mask @ table
        else:
            kind, masks = self.slots.dtype.type, np.atleast_2d(mask)
            seen = np.array([int(((masks[i // 64] >> kind(i % 64)) & kind(1)).sum()) for i in range(len(self.languages))])
        return np.maximum(0, (seen - len(keys) * self.false_rate) / (1 - self.false_rate))

    def decide(self, text: str | None) -> tuple[str, float, float]:
        """``(language, score, contained)``: the decision, its share among languages, the share of n-grams known to it.

        ``und`` with zeros for a null text or one without a letter. Ties go to
        the language that comes first in order; a text too short for an
        n-gram, or with none that a filter holds, to the commonest one with
        zeros.
        """
        keys, letter = ngrams(text or "")
        if not letter:
            return "und", 0.0, 0.0
        if not len(keys) or not self.languages:
            return (self.languages[self.usual], 0.0, 0.0) if self.languages else ("und", 0.0, 0.0)
        found = self.counts(keys) / self.share
        total = found.sum()
        best = int(found.argmax()) if total > 0 else self.usual
        contained = min(1.0, float(self.counts(keys)[best]) / len(keys))
        return self.languages[best], float(found[best] / total) if total > 0 else 0.0, contained


def positions(keys: np.ndarray, bits: int, hashes: int) -> Iterator[np.ndarray]:
    for i in range(hashes):
        yield (keys >> np.uint64(i * bits)) & np.uint64((1 << bits) - 1)


# --------------------------------------------------------------- operators


def in_fold(id_col: str, folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def train(docs: DataFrame, each: int = 1_500, vocabulary: int = 60_000, distinctive: float = 0.2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> BitSlicedBloom:
    """Filters from at most ``each`` documents a language.

    Learns only from rows with a language outside the held-out fold. A hash
    of the id, thresholded by the languages' row counts and then ranked,
    chooses the rows. A language's filter holds its ``vocabulary`` commonest
    n-grams whose share of its text is at least ``distinctive`` times the
    largest share in any language, so that stray passages in other
    languages don't enter. Over ``MOST`` languages are an error. ``share``
    keeps the part of a language's own n-grams that its filter holds. At most
    languages x vocabulary counts reach the driver. With no row to learn
    from there are no languages, and every text is ``und``.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~in_fold("doc_id"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST + 1).collect()}
    languages = sorted(sizes)
    if len(languages) > MOST:
        raise ValueError(f"{MOST} languages at most")
    if not languages:
        return BitSlicedBloom.build([], [])
    unit = (F.xxhash64("doc_id", F.lit(7)).bitwiseAND(F.lit((1 << 52) - 1))) / F.lit(float(1 << 52))
    bound = F.create_map(*(x for lang in languages for x in (F.lit(lang), F.lit(min(1.0, 2.0 * each / sizes[lang])))))
    ranked = rows.where(F.col("lang").isin(languages)).withColumn("unit", unit).where(F.col("unit") <= bound[F.col("lang")])
    order = Window.partitionBy("lang").orderBy("unit", "doc_id")
    sample = ranked.withColumn("at", F.row_number().over(order)).where(F.col("at") <= each).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                keys, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "key", "n"])
            held.clear()

        waiting = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys, _ = ngrams(text.as_py())
                held.setdefault(lang, []).append(keys)
                waiting += len(keys)
                if waiting > 2_000_000:
                    yield from flush()
                    waiting = 0
        yield from flush()

    counts = sample.repartition(8).mapInArrow(run, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    totals = Window.partitionBy("lang")
    shares = counts.withColumn("total", F.sum("n").over(totals)).withColumn("share", F.col("n") / F.col("total"))
    own = shares.withColumn("top", F.max("share").over(Window.partitionBy("key"))).where(F.col("share") >= distinctive * F.col("top"))
    common = own.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "key"))).where(F.col("at") <= vocabulary)
    found = common.select("lang", "key", "share").toPandas()
    keys, held = [], []
    for lang in languages:
        part = found[found["lang"] == lang]
        keys.append(part["key"].to_numpy(dtype=np.int64).view(np.uint64))
        held.append(max(float(part["share"].sum()), 1e-6))
    bloom = BitSlicedBloom.build(languages, keys)
    bloom.share = np.array(held)
    bloom.usual = max(range(len(languages)), key=lambda k: (sizes[languages[k]], -k))
    return bloom


def identify(text: Column, bloom: BitSlicedBloom) -> Column:
    """A struct ``(lang_pred, score, contained)`` for each whole text."""
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("contained", pa.float64())])

    @arrow_udf("lang_pred string, score double, contained double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in trimmed(batches):
            found = [bloom.decide(t.as_py()) for t in batch]
            yield pa.array([dict(zip(("lang_pred", "score", "contained"), x)) for x in found], type=kind)

    return run(text)


def identify_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, contained)`` for every row of ``docs``.

    Null texts and texts without a letter are ``und`` with score 0. Repeated
    rows and rows with a null id are rows of their own (a null id is never
    held out, and never learned from); other columns aren't read. No rows
    give no rows.
    """
    bloom = train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), identify(F.col(text_col).cast("string"), bloom).alias("x"))
    return found.select("doc_id", in_fold("doc_id").alias("held_out"), "x.*")


def keep_identified(docs: DataFrame, least: float = 0.4, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose text is in a learned language; columns as they are.

    A text goes if it is null or has no letter, or if its language's filter
    contains fewer than ``least`` of its n-grams. Rows are judged one by one,
    so repeated rows go or stay together, whatever their id.
    """
    bloom = train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    return docs.where(identify(F.col(text_col).cast("string"), bloom)["contained"] >= least)
