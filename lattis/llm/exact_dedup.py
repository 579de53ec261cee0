"""Exact duplicates by a 128-bit content hash, with bytes compared inside groups.

Everything here is built-in functions and DataFrame operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattis.llm.hot import join_groups
from lattis.session import materialize


def content_hash(text: Column) -> Column:
    """128 bits of the text's UTF-8 bytes."""
    return F.unhex(F.md5(text))


def _groups(rows: DataFrame, keys: list[str], best: Callable[[Column], Column]) -> DataFrame:
    return rows.groupBy(*keys).agg(best(F.col("_id")).alias("keep_id"), F.count("*").alias("group_size"))


def _keyed(docs: DataFrame, id_col: str, text_col: str, normalise: Callable[[Column], Column] | None, hashed: Callable[[Column], Column]) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    text = normalise(text) if normalise else text
    return docs.select(F.col(id_col).alias("_id"), text.alias("_text")).select("_id", "_text", hashed(F.col("_text")).alias("_hash"))


def exact_duplicates(
    docs: DataFrame,
    keep: str = "smallest",
    normalise: Callable[[Column], Column] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    hashed: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``: a row a document.

    Texts are equal if they are identical, byte for byte, after
    ``normalise`` (nothing by default); null counts as empty. Of equal
    texts the ``keep`` (``"smallest"`` or ``"largest"``) id stays.
    ``text_sha256`` is of the normalised text in UTF-8.

    Rows that repeat id and text are one document and answer alike. A row
    without an id counts in its group, and stays only where no row of the
    group has one. An empty table gives no rows. Other columns of ``docs``
    play no part, whatever their names.

    Texts are grouped by hash and bytes at once: each task sends one row a
    distinct text, so a text that a third of all rows hold is combined
    before it moves. A hash that groups different texts (a collision, which
    is found because the bytes are part of the key) is then settled by the
    texts of its own documents. Documents meet their group by hash; heavy
    groups are broadcast, a thousand at most (:func:`join_groups`). To the
    driver go two numbers.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep is smallest or largest, not {keep}")
    best = F.min if keep == "smallest" else F.max
    keyed = _keyed(docs, id_col, text_col, normalise, hashed)
    by_text = _groups(keyed, ["_hash", "_text"], best).drop("_text")
    by_hash = by_text.groupBy("_hash").agg(F.count("*").alias("_texts"), best("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    groups = materialize(by_hash, "hashes")
    known = groups.agg(F.sum("group_size").alias("n"), F.count_if(F.col("_texts") > 1).alias("mixed")).first()
    slim = keyed.select("_id", "_hash", F.sha2("_text", 256).alias("text_sha256"))
    one = groups if not known["mixed"] else groups.where("_texts = 1")
    met = join_groups(slim, one.drop("_texts"), "_hash", "group_size", known["n"] or 0)
    if known["mixed"]:
        apart = keyed.join(groups.where("_texts > 1").select("_hash"), "_hash", "left_semi")
        split = materialize(_groups(apart, ["_hash", "_text"], best).select("*", F.struct("_hash", "_text").alias("_key")), "collisions")
        rows = apart.select("_id", "_hash", F.sha2("_text", 256).alias("text_sha256"), F.struct("_hash", "_text").alias("_key"))
        met = met.unionByName(join_groups(rows, split.select("_key", "keep_id", "group_size"), "_key", "group_size", known["n"]).drop("_key"))
    return met.select(F.col("_id").alias("doc_id"), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_one_of_each(docs: DataFrame, keep: str = "smallest", normalise: Callable[[Column], Column] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose document stays; see :func:`exact_duplicates`.

    Ids are taken to name one text each; rows without an id stay where none
    of their text has one.
    """
    met = exact_duplicates(docs, keep, normalise, id_col, text_col)
    named = met.where("kept and doc_id is not null").select(F.col("doc_id").alias("_kept")).distinct()
    stay = docs.join(named, F.col(id_col) == F.col("_kept"), "left_semi")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    alone = met.where("kept and doc_id is null").select(F.col("text_sha256").alias("_sha")).distinct()
    bare = docs.where(F.col(id_col).isNull()).join(alone, F.sha2(normalise(text) if normalise else text, 256) == F.col("_sha"), "left_semi")
    return stay.unionByName(bare)
