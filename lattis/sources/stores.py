"""Sources: schema-tolerant tables, scaffolds, graph payloads, dependency lists, vaults, corpora."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattis.operators.topology import valid_edges
from lattis.schema import Graph, empty_graph

#: Column names that may hold a name or a type, in order; and what is never a graph.
NAME_COLUMNS = ("name", "title", "label", "text")
TYPE_COLUMNS = ("entity_type", "node_type", "type", "category", "note_type")
VECTOR_COLUMNS = ("embedding", "vector", "vec")
OPERATIONAL = ("migrations", "sessions", "cache", "jobs", "audit_log", "embeddings_meta", "settings")


def _first(df: DataFrame, names: tuple[str, ...]) -> str | None:
    return next((c for c in names if c in df.columns), None)


def project_nodes(df: DataFrame, table: str, row_wise: bool = False) -> DataFrame | None:
    """``ENTITY`` rows of a table with an ``id`` column, or None (SRC3).

    The name is the first candidate column there is, or with ``row_wise``
    the first that isn't empty in a row (SRC6); without one the id. The type
    falls back to the table. Vector columns are never read.
    """
    if "id" not in df.columns:
        return None
    key = F.concat(F.lit(f"{table}:"), F.col("id").cast("string"))
    filled = lambda c: F.when(F.col(c).cast("string") != "", F.col(c).cast("string"))
    pick = lambda names: [filled(c) for c in names if c in df.columns] if row_wise else [filled(c) for c in (_first(df, names),) if c]
    return df.select(key.alias("id"), F.coalesce(*pick(NAME_COLUMNS), F.col("id").cast("string")).alias("name"), F.coalesce(*pick(TYPE_COLUMNS), F.lit(table)).alias("entity_type"))


def project_edges(df: DataFrame, table: str, source_table: str, target_table: str, source: str = "source_id", target: str = "target_id") -> DataFrame:
    """``(source_id, target_id, edge_type, created_by, source_pattern)`` of a table (SRC4)."""
    end = lambda t, c: F.concat(F.lit(f"{t}:"), F.col(c).cast("string"))
    own = F.when(F.col("edge_type") != "", F.col("edge_type")) if "edge_type" in df.columns else F.lit(None).cast("string")
    extra = lambda c: (F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string"))
    return df.select(end(source_table, source).alias("source_id"), end(target_table, target).alias("target_id"), F.coalesce(own, F.lit(table)).alias("edge_type"), extra("extraction_source").alias("created_by"), extra("source_pattern").alias("source_pattern"))


def select_tables(sizes: dict[str, int], auto_discover: bool = False, edges: bool = False) -> list[str]:
    """Tables to read: no operational ones; edge tables and discovered ones only if they have rows (SRC5)."""
    return sorted(t for t, n in sizes.items() if t not in OPERATIONAL and (n > 0 or not (edges or auto_discover)))


def scaffold(chunks: DataFrame, most_drawers: int | None = None) -> Graph:
    """Wings, rooms and drawers of ``(chunk_id, wing, room, hall, file, seq)`` (SRC7).

    Empty rooms and ``general`` are no rooms. A room is typed by its
    smallest hall; two wings that share a room are joined by a tunnel; a
    file's chunks hang on its first one, not on each other.
    """
    wing, room = (lambda c: F.concat(F.lit("wing:"), c)), (lambda c: F.concat(F.lit("room:"), c))
    named = chunks.where("coalesce(room, '') not in ('', 'general')")
    wings = chunks.where("coalesce(wing, '') <> ''").select("wing").distinct()
    rooms = named.groupBy("room").agg(F.min(F.when(F.col("hall") != "", F.col("hall"))).alias("hall"))
    nodes = wings.select(wing(F.col("wing")).alias("id"), F.col("wing").alias("name"), F.lit("wing").alias("entity_type")).unionByName(
        rooms.select(room(F.col("room")).alias("id"), F.col("room").alias("name"), F.concat(F.lit("room:"), F.coalesce("hall", F.lit("untyped"))).alias("entity_type"))
    )
    held = named.where("coalesce(wing, '') <> ''").select("wing", "room").distinct()
    member = held.select(room(F.col("room")).alias("source_id"), wing(F.col("wing")).alias("target_id"), F.lit("member_of").alias("edge_type"))
    edges = member.unionByName(tunnels(held).select(wing(F.col("a")).alias("source_id"), wing(F.col("b")).alias("target_id"), F.lit("tunnel").alias("edge_type")))
    if most_drawers is None or chunks.count() <= most_drawers:
        drawer = lambda c: F.concat(F.lit("drawer:"), F.col(c).cast("string"))
        nodes = nodes.unionByName(chunks.select(drawer("chunk_id").alias("id"), F.col("chunk_id").cast("string").alias("name"), F.concat(F.lit("drawer:"), F.coalesce(F.when(F.col("hall") != "", F.col("hall")), F.lit("untyped"))).alias("entity_type")))
        filed = named.select(drawer("chunk_id").alias("source_id"), room(F.col("room")).alias("target_id"), F.lit("filed_in").alias("edge_type"))
        hub = F.first("chunk_id").over(Window.partitionBy("file").orderBy("seq", "chunk_id"))
        same = chunks.where("file is not null").withColumn("hub", hub).where("hub <> chunk_id").select(drawer("hub").alias("source_id"), drawer("chunk_id").alias("target_id"), F.lit("same_file").alias("edge_type"))
        edges = edges.unionByName(filed).unionByName(same)
    return Graph(nodes, edges)


def tunnels(held: DataFrame) -> DataFrame:
    """``(room, a, b)`` for every two wings ``a < b`` that share a room (JN10).

    The result itself is one row a pair of wings; wings are few.
    """
    a, b = held.select("room", F.col("wing").alias("a")), held.select("room", F.col("wing").alias("b"))
    return a.join(b, "room").where("a < b")


def synthesize_endpoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, and one of type ``kg:entity`` for each edge end that isn't among them (SRC8)."""
    ends = edges.select(F.col("source_id").alias("id")).union(edges.select("target_id")).distinct()
    missing = ends.join(nodes.select("id"), "id", "left_anti").select("id", F.regexp_replace("id", "^[^:]*:", "").alias("name"), F.lit("kg:entity").alias("entity_type"))
    return nodes.select("id", "name", "entity_type").unionByName(missing)


def knowledge_graph(entities: DataFrame, triples: DataFrame) -> Graph:
    """The graph of a store's ``entities`` and ``triples`` tables (SRC9).

    Identifiers and types get the prefix ``kg:``; properties that aren't a
    JSON object are none. ``_created_at`` is an entity's ``created_at`` and a
    triple's ``valid_from``. A null type is ``kg:unknown``, a null or empty
    predicate ``kg_related``. Columns that a table lacks are null.
    """
    col = lambda df, c, kind="string": F.col(c).cast(kind) if c in df.columns else F.lit(None).cast(kind)
    kg = lambda c: F.concat(F.lit("kg:"), c)
    given = F.coalesce(F.from_json(col(entities, "properties"), "map<string,string>", {"mode": "PERMISSIVE"}), F.create_map().cast("map<string,string>"))
    given = F.map_filter(given, lambda k, _: ~k.isin("_table", "_created_at"))
    own = F.map_concat(given, F.create_map(F.lit("_table"), F.lit("kg_entity"), F.lit("_created_at"), col(entities, "created_at")))
    kind = F.coalesce(F.when(col(entities, "type") != "", col(entities, "type")), F.lit("unknown"))
    nodes = entities.select(kg(col(entities, "id")).alias("id"), col(entities, "name").alias("name"), kg(kind).alias("entity_type"), own.alias("properties"))
    kept = ("valid_to", "confidence", "source_closet", "source_file")
    about = F.create_map(F.lit("_table"), F.lit("kg_triple"), F.lit("_created_at"), col(triples, "valid_from"), *(x for c in kept for x in (F.lit(c), col(triples, c))))
    predicate = F.coalesce(F.when(col(triples, "predicate") != "", col(triples, "predicate")), F.lit("kg_related"))
    edges = triples.select(kg(col(triples, "subject")).alias("source_id"), kg(col(triples, "object")).alias("target_id"), predicate.alias("edge_type"), about.alias("properties"))
    return Graph(nodes, edges)


def cached_statistics(spark: SparkSession, path: str, needs: str = "component_count") -> DataFrame | None:
    """Statistics that another job wrote at ``path``; None if there are none, or none with the column ``needs`` (SRC14). Nothing is computed here."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    found = spark.read.parquet(path)
    return found if needs in found.columns else None


def native_contradictions(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``(a, b, claim_a)`` of unordered pairs, once; the claim is the memory's text, description or id (SRC11)."""
    once = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    said = texts.select(F.col("id").alias("a"), F.coalesce(F.when(F.col("text") != "", F.col("text")), F.when(F.col("description") != "", F.col("description"))).alias("said"))
    return once.join(said, "a", "left").select("a", "b", F.coalesce("said", "a").alias("claim_a"))


def dag(rows: DataFrame) -> tuple[Graph, DataFrame]:
    """The graph of ``ConceptID, ConceptLabel, Dependencies, TaxonomyID`` and its ``(problem, id)`` (SRC18).

    The first row of a repeated id counts and is a warning; a parent that
    isn't there is a phantom dependency and its edge is dropped.
    """
    first = Window.partitionBy("ConceptID").orderBy("ConceptLabel")
    numbered = rows.withColumn("k", F.row_number().over(first))
    one = numbered.where("k = 1")
    nodes = one.select(F.col("ConceptID").alias("id"), F.col("ConceptLabel").alias("name"), F.col("TaxonomyID").alias("entity_type"))
    parents = F.filter(F.transform(F.split(F.coalesce("Dependencies", F.lit("")), r"\|"), lambda p: F.trim(p)), lambda p: p != "")
    edges = one.select(F.col("ConceptID").alias("source_id"), F.explode(parents).alias("target_id"), F.lit("DEPENDS_ON").alias("edge_type"))
    repeated = numbered.where("k = 2").select(F.lit("duplicate").alias("problem"), F.col("ConceptID").alias("id"))
    phantom = edges.join(nodes.select(F.col("id").alias("target_id")), "target_id", "left_anti").select(F.lit("phantom").alias("problem"), F.col("target_id").alias("id")).distinct()
    return Graph(nodes, valid_edges(edges, nodes)), repeated.unionByName(phantom)


FRONTMATTER = r"(?s)^---\n.*?\n---\n?"


def source_bodies(notes: DataFrame) -> DataFrame:
    """``(path, body)`` with the front matter taken off, once (SRC20)."""
    return notes.select("path", F.regexp_replace("text", FRONTMATTER, "").alias("body"))


def vault(notes: DataFrame) -> Graph:
    """The graph that notes ``(path, text)`` declare in their front matter (SRC19).

    Entities are ``- {id: x, type: t, canonical: n}`` and edges
    ``- {from: a, type: t, to: b}`` in flow style. Notes are taken in the
    order of their paths: the first declaration of an id wins; an edge needs
    its three fields.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(path, i, d.get("id"), d.get("canonical"), d.get("type"), d.get("from"), d.get("to")) for path, text in zip(*(c.to_pylist() for c in batch.columns)) for i, d in enumerate(_declared(text or ""))]
            names = ["path", "i", "id", "canonical", "type", "a", "b"]
            kinds = [pa.string(), pa.int32(), *[pa.string()] * 5]
            columns = list(zip(*out)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], names=names)

    found = notes.select("path", "text").mapInArrow(run, "path string, i int, id string, canonical string, type string, a string, b string")
    nodes = found.where("id is not null").groupBy("id").agg(F.min_by(F.struct(F.coalesce("canonical", "id").alias("name"), F.col("type").alias("entity_type")), F.struct("path", "i")).alias("x")).select("id", "x.*")
    edges = found.where("a is not null and b is not null and type is not null").select(F.col("a").alias("source_id"), F.col("b").alias("target_id"), F.col("type").alias("edge_type"), F.col("path").alias("source_note"))
    return Graph(nodes, edges)


def _declared(text: str) -> list[dict[str, str]]:
    import re

    head = re.match(r"(?s)^---\n(.*?)\n---", text)
    lines = re.findall(r"^\s*-\s*\{(.*)\}\s*$", head[1], re.M) if head else []
    return [{k.strip(): v.strip().strip("\"'") for k, _, v in (x.partition(":") for x in re.split(r",\s*(?=\w+:)", line))} for line in lines]


def evidence_sessions(refs: Column) -> Column:
    """Distinct session numbers of ``D<session>:<turn>`` references, in order (SRC22)."""
    found = F.transform(refs, lambda r: F.regexp_extract(r, r"D(\d+):", 1))
    return F.array_distinct(F.transform(F.filter(found, lambda s: s != ""), lambda s: s.cast("int")))


#: What kind of question each type asks.
QUESTION_CATEGORIES = {"single-session-user": "1", "single-session-assistant": "1", "single-session-preference": "1", "multi-session": "2", "temporal-reasoning": "6", "knowledge-update": "3"}


def haystack_questions(raw: DataFrame) -> DataFrame:
    """``(question_id, category, abstention, session_id, date, turns)``: one row a session (SRC21).

    ``raw`` has parallel arrays of sessions, ids and dates; arrays of
    different lengths are an error.
    """
    n = F.size("haystack_sessions")
    same = (n == F.size("haystack_session_ids")) & (n == F.size("haystack_dates"))
    zipped = F.when(same, F.arrays_zip("haystack_session_ids", "haystack_dates", "haystack_sessions")).otherwise(F.raise_error(F.lit("haystack arrays differ in length")))
    category = F.create_map(*(F.lit(x) for kv in QUESTION_CATEGORIES.items() for x in kv))[F.col("question_type")]
    rows = raw.select("question_id", F.coalesce(category, F.lit("1")).alias("category"), F.col("question_id").endswith("_abs").alias("abstention"), F.posexplode(zipped).alias("i", "x"))
    return rows.select("question_id", "category", "abstention", "i", F.col("x.haystack_session_ids").alias("session_id"), F.col("x.haystack_dates").alias("date"), F.col("x.haystack_sessions").alias("turns"))


def paragraph_questions(raw: DataFrame) -> DataFrame:
    """``(id, title, text, gold)`` a paragraph; gold if its title is among the well-formed supporting facts (SRC24)."""
    facts = F.transform(F.filter("supporting_facts", lambda f: F.size(f) == 2), lambda f: F.get(f, F.lit(0)))
    rows = raw.select(F.col("_id").alias("id"), facts.alias("facts"), F.explode("context").alias("c"))
    return rows.select("id", F.col("c.title").alias("title"), F.array_join("c.sentences", "").alias("text"), F.array_contains("facts", F.col("c.title")).alias("gold"))


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a file of JSON lines; blank lines are skipped, broken ones are null rows (SRC26)."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def retrieve_results(raw: DataFrame) -> DataFrame:
    """One row a question of a retrieve-result JSON (SRC27)."""
    return raw.select("adapter", F.explode("questions").alias("q")).select("adapter", "q.*")


def eav_pivot(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Entity-attribute-value rows as columns, one pass, no join (SRC28)."""
    return rows.groupBy("id").agg(*(F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in keys))


#: Sources by alias; each takes the session and its own options (SRC2).
REGISTRY: dict[str, Callable[..., Graph]] = {}


def register(alias: str) -> Callable[[Callable[..., Graph]], Callable[..., Graph]]:
    def add(f: Callable[..., Graph]) -> Callable[..., Graph]:
        REGISTRY[alias] = f
        return f

    return add


def load(alias: str, spark: SparkSession, **options: object) -> Graph:
    """A registered source's snapshot. Options that are None are left out; unknown ones, and unknown aliases, are errors."""
    import inspect

    if alias not in REGISTRY:
        raise KeyError(f"no source {alias!r}; there are {sorted(REGISTRY)}")
    given = {k: v for k, v in options.items() if v is not None}
    unknown = set(given) - set(inspect.signature(REGISTRY[alias]).parameters)
    if unknown:
        raise TypeError(f"{alias} takes no {sorted(unknown)}")
    return REGISTRY[alias](spark, **given)


@register("flat")
def flat(spark: SparkSession) -> Graph:
    """A store that retrieves but holds no graph (SRC16)."""
    return empty_graph(spark)


@register("memories")
def memories(spark: SparkSession, path: str) -> Graph:
    """Flat memories: nodes of their own, no edges (SRC15)."""
    return Graph(project_nodes(spark.read.parquet(path), "memory"), empty_graph(spark).edges)


@register("tables")
def tables(spark: SparkSession, sf_dir: str, graph: str = "trade") -> Graph:
    """One of the graphs projected from the relational tables (SRC1)."""
    from lattis.sources import graphs

    return getattr(graphs, graph)(spark, sf_dir)
