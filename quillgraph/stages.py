"""The stages from filings to answers, over tables in one folder; each reads what the one before wrote."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph import schemas as S
from quillgraph.operators import chat, chunking, gate, graph, models, reports, resolve, routing, strict, validate
from quillgraph.operators.ann_index import Index
from quillgraph.operators.ask import ask
from quillgraph.operators.fulltext import Inverted
from quillgraph.runtime import materialize, numbered
from quillgraph.sources import jsonl, sections
from quillgraph.streaming.merge import Bucketed

STAGES = ("fetch", "chunk", "extract", "resolve", "load", "embed")
FILINGS = "ticker string, company string, cik long, form string, accession string, filing_date date, sections map<string, string>, exhibits array<struct<kind: string, text: string>>"
NODES = "id string, name string, type string, aliases array<string>, mention_count long"
PROPER = {"type": "string"}
EXTRACTION = {
    "type": "object",
    "required": ["mentions", "relations"],
    "properties": {
        "mentions": {"type": "array", "items": {"type": "object", "required": ["name", "type"], "properties": {"name": PROPER, "type": {"enum": list(S.ENTITY_TYPES)}}}},
        "relations": {
            "type": "array",
            "items": {
                "type": "object",
                "required": ["subject", "predicate", "object", "confidence", "evidence"],
                "properties": {"subject": PROPER, "predicate": {"enum": [r[0] for r in S.RELATIONS]}, "object": PROPER, "confidence": {"enum": ["high", "medium", "low"]}, "evidence": PROPER},
            },
        },
    },
}
READ = f"mentions array<{S.MENTION}>, relations array<{S.RELATION}>"


@dataclass
class Models:
    """What the stages need of models: an extracting call with its usage, a plain chat function, an embedding function of some width."""

    extract: chat.Call
    chat: models.Chat
    embed: models.Embed
    width: int
    name: str = "model"
    prompts: dict | None = None


class Workspace:
    """Tables of one corpus in a folder that all executors see."""

    def __init__(self, spark: SparkSession, folder: str, of: Models, say: Callable[[str], None] = print):
        self.spark, self.folder, self.models, self.say = spark, folder.rstrip("/"), of, say
        self.nodes = Bucketed(spark, f"{self.folder}/nodes", NODES, ["id"])
        self.edges = Bucketed(spark, f"{self.folder}/edges", S.EDGES, ["subject_id", "predicate", "object_id"])
        self.passages = Bucketed(spark, f"{self.folder}/passages", f"{S.CHUNKS}, ordinal long, entity_ids array<string>, embedding array<float>", ["chunk_id"])

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self._path(name)
        return self.spark.read.schema(schema).parquet(path) if jsonl.exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def _number(self, table: Bucketed) -> int:
        return table.manifest.latest()[1].get("batch", -1) + 1

    def fetch(self, filings: str | DataFrame) -> None:
        """Sections of the newest filings of each kind, from JSON lines of filings, or a table."""
        rows = jsonl.read(self.spark, filings, FILINGS) if isinstance(filings, str) else filings
        sections.flatten(sections.newest(rows)).write.mode("overwrite").parquet(self._path("docs"))
        self.say(f"{self._read('docs', S.DOCS).count()} sections")

    def chunk(self) -> None:
        docs = self._read("docs", S.DOCS)
        rows = chunking.chunk(docs, ["accession", "section_path"])
        kept = rows.filter(chunking.keep("text", F.col("form") == "DEF 14A"))
        kept.write.mode("overwrite").parquet(self._path("chunks"))
        if repeated := chunking.duplicated(self.chunks, "chunk_id").count():
            raise ValueError(f"{repeated} chunk ids occur twice")
        self.say(f"{self.chunks.count()} chunks")

    @property
    def chunks(self) -> DataFrame:
        return self._read("chunks", f"{S.CHUNKS}, ordinal long")

    @property
    def extractions(self) -> DataFrame:
        return self._read("extractions", S.EXTRACTIONS)

    @property
    def entities(self) -> DataFrame:
        return self._read("entities", S.ENTITIES)

    @cached_property
    def calls(self) -> chat.ChatTable:
        return chat.ChatTable(self.spark, self._path("calls"), self.models.extract, self.models.name, EXTRACTION, per_minute=6000)

    def extract(self, budget: float = 5.0, limit: int | None = None) -> None:
        """Ask for each chunk's mentions and relations, once more where a reply doesn't hold, and keep what the vocabulary and the text bear out."""
        done = self.extractions.select("chunk_id")
        todo = self.chunks.join(done, "chunk_id", "left_anti")
        todo = todo.orderBy("chunk_id").limit(limit) if limit else todo
        system = (self.models.prompts or {}).get("extract", reports.vocabulary_block())
        asked = todo.withColumns({"system": F.lit(system), "user": reports.chunk_prompt("company", "section_path", "filing_date", "text")})
        before = self.calls.meter().first().usd
        first = strict.checked(self.calls.replies(asked, budget), "reply", EXTRACTION, READ)
        first = materialize(first, "replies")
        again = F.concat("user", F.lit("\n\nThe last reply was rejected: "), F.array_join("problems", "; "))
        wrong = first.filter("error is null and size(problems) > 0").withColumn("user", again).select(*asked.columns)
        left = budget - (self.calls.meter().first().usd - before)
        second = materialize(strict.checked(self.calls.replies(wrong, left), "reply", EXTRACTION, READ), "replies")
        held = first.withColumn("attempts", F.lit(1)).unionByName(second.withColumn("attempts", F.lit(2)))
        good = held.filter("error is null and size(problems) = 0").select(*todo.columns, "attempts", "parsed.mentions", "parsed.relations")
        judged = validate.reasons(validate.with_types(good), S.ontology(self.spark))
        kept = judged.filter("reason is null").groupBy("chunk_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rel_ord", F.struct("subject", "predicate", "object", "confidence", "evidence").alias("r")))), lambda x: x["r"]).alias("kept"))
        dropped = judged.filter("reason is not null").groupBy("chunk_id", "reason").agg(F.count("*").alias("n")).groupBy("chunk_id").agg(F.map_from_entries(F.collect_list(F.struct("reason", "n"))).alias("dropped"))
        rows = good.join(kept, "chunk_id", "left").join(dropped, "chunk_id", "left")
        out = rows.withColumns({"relations": F.coalesce("kept", F.array().cast(f"array<{S.RELATION}>")), "dropped": F.coalesce("dropped", F.create_map().cast("map<string,bigint>"))})
        out.select(*[F.col(f.name).cast(f.dataType) for f in S.struct_of(S.EXTRACTIONS)]).write.mode("append").parquet(self._path("extractions"))
        lost = second.filter("error is not null or size(problems) > 0").select("chunk_id", F.coalesce("error", F.array_join("problems", "; ")).alias("error"))
        lost = lost.unionByName(first.filter("error is not null").select("chunk_id", "error"))
        lost.write.mode("overwrite").parquet(self._path("quarantine"))
        m = self.calls.meter().first()
        self.say(f"{self.extractions.count()} extracted, {lost.count()} refused, {m.calls} calls, {m.usd:.4f} USD")

    def resolve(self, overrides: DataFrame | None = None) -> None:
        """Entities of all mentions: by the aliases that chunks declare and by hand overrides, which win, then by rules."""
        rows = numbered(self.extractions, ["chunk_id"], "row_ord")
        mentions = resolve.mentions(rows.select("row_ord", "chunk_id", "mentions"))
        records = numbered(mentions.withColumns({"o1": F.col("ord.row_ord"), "o2": F.col("ord.pos")}), ["o1", "o2", "surface", "type"], "id").drop("o1", "o2")
        records = materialize(records, "records")
        norms = records.select("norm", F.col("norm").alias("text")).distinct()
        vectors = models.embed_missing(norms, self.spark.createDataFrame([], "norm string, embedding array<float>"), self.models.embed, key="norm")
        declared = resolve.declared_pairs(self.chunks, norms).withColumn("same", F.lit(True))
        hand = overrides if overrides is not None else self.spark.createDataFrame([], S.OVERRIDES)
        known = hand.select("a", "b", "same").unionByName(declared.join(hand, ["a", "b"], "left_anti").select("a", "b", "same"))
        whole = materialize(records.join(materialize(vectors, "vectors"), "norm"), "records")
        matched = resolve.matches(whole, known, resolve.markers(records.filter("type = 'Location'")))
        built = resolve.entities(whole, materialize(matched, "matched"))
        built.select(*S.struct_of(S.ENTITIES).names).write.mode("overwrite").parquet(self._path("entities"))
        self.say(f"{self.entities.count()} entities of {records.count()} names")

    def load(self, full_refresh: bool = False) -> None:
        """Merge entities and relations into the graph; a second time it changes nothing."""
        entities = self.entities
        nodes = entities.select(F.col("canonical_id").alias("id"), "name", "type", "aliases", "mention_count")
        self.nodes.merge(nodes, graph.merge_nodes, self._number(self.nodes))
        surfaces = entities.select("type", F.col("canonical_id").alias("id"), F.explode(F.array_union(F.array("name"), "aliases")).alias("surface"), F.col("canonical_id").alias("ord"))
        rows = validate.with_types(self.extractions.select("chunk_id", "mentions", "relations"))
        ends = graph.resolve_endpoints(rows, surfaces)
        facts = ends.filter("subject_id is not null and object_id is not null").withColumn("ord", F.struct("chunk_id", "rel_ord"))
        edges = graph.collapse(facts).select(*S.struct_of(S.EDGES).names)
        known = self.nodes.read()
        self.edges.merge(edges, lambda old, new: graph.merge_edges(old, new, known, full_refresh).select(*S.struct_of(S.EDGES).names), self._number(self.edges))
        lost = {r.reason: r.n for r in graph.discarded(ends).collect()}
        self.say(f"{self.nodes.read().count()} nodes, {self.edges.read().count()} edges, left out: {lost}")

    def embed(self) -> None:
        """Passages with their entities and vectors, of which those that are there already are kept, and an index over them."""
        before = self.passages.read().filter("embedding is not null").select("chunk_id", "embedding")
        vectors = materialize(models.embed_missing(self.chunks.select("chunk_id", "text"), before, self.models.embed), "vectors")
        rows = graph.store_rows(self.chunks, self.entities).join(vectors, "chunk_id", "left")
        fields = S.struct_of(self.passages.schema)
        rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in fields])
        self.passages.merge(rows, lambda old, new: new.select(*fields.names), self._number(self.passages))
        number = self.passages.manifest.latest()[0]
        Index.build(self._vectors(), self._path(f"index-{number}"), self.models.width)
        Inverted.build(routing.name_texts(routing.alias_index(self.entities)), self._path("names"))
        self.say(f"{self.passages.read().count()} passages")

    def _vectors(self) -> DataFrame:
        return self.passages.read().select(F.xxhash64("chunk_id").alias("id"), "embedding")

    def index(self) -> Index | None:
        path = self._path(f"index-{self.passages.manifest.latest()[0]}")
        return Index(self.spark, path) if jsonl.exists(self.spark, f"{path}/states") else None

    def verify(self) -> list[str]:
        """The gate's failures, which are said one by one."""
        figures, failures = gate.verify(self.nodes.read(), self.edges.read(), self.passages.read(), self.chunks, indexes={"embedding": self.index()})
        self.say(", ".join(f"{k} {v}" for k, v in figures.items() if not k.startswith("edges of")))
        for failure in failures:
            self.say(f"FAIL {failure}")
        return failures

    def ask(self, question: str, k: int = 10) -> dict:
        """A question's route, evidence and answer."""
        prompts = {"plan": "plan", "answer": "answer"} | (self.models.prompts or {})
        store = self.passages.read().select("chunk_id", "text", "embedding")
        return ask(question, chat=self.models.chat, embed=self.models.embed, store=store, nodes=self.nodes.read().select("id", "name", "type"), edges=self.edges.read(), index=routing.alias_index(self.entities), prompts=prompts, k=k)

    def health(self) -> dict:
        return {"status": "ok", "entities": self.nodes.read().count(), "chunks": self.passages.read().count()}
