"""Table schemas and the closed vocabulary of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

DOCS = "ticker string, company string, cik long, form string, accession string, filing_date date, section_path string, text string"
CHUNKS = "chunk_id string, " + DOCS
MENTION = "struct<name: string, type: string>"
RELATION = "struct<subject: string, predicate: string, object: string, confidence: string, evidence: string>"
EXTRACTIONS = f"chunk_id string, ticker string, section_path string, filing_date date, mentions array<{MENTION}>, relations array<{RELATION}>, dropped map<string, long>, attempts long"
ENTITIES = "canonical_id string, type string, name string, aliases array<string>, mention_chunks array<string>, mention_count long"
EDGES = "subject_id string, predicate string, object_id string, chunk_ids array<string>, support long, confidence string"
OVERRIDES = "a string, b string, same boolean"
QUESTIONS = "qid string, question string, gold_chunk_ids array<string>, hops long, source string, predicate string, expected_answers array<string>, kind string, note string, category string, expected_count long"
CLAIM = "struct<text: string, citations: array<string>>"

# Entity types, relations with their signature, phrase and inbound plural, and risk topics.
ENTITY_TYPES = ("Company", "Person", "Product", "Location", "Regulator", "RiskTopic", "LegalProceeding")
RELATIONS = (
    ("SUBSIDIARY_OF", "Company", "Company", "is a subsidiary of", "subsidiaries"),
    ("ACQUIRED", "Company", "Company", "acquired", "acquirers"),
    ("COMPETES_WITH", "Company", "Company", "competes with", "companies naming it as a competitor"),
    ("SUPPLIES", "Company", "Company", "supplies", "suppliers"),
    ("PARTNERS_WITH", "Company", "Company", "has a named partnership with", "named partners"),
    ("AUDITED_BY", "Company", "Company", "is audited by", "audit clients"),
    ("OFFICER_OF", "Person", "Company", "is an executive officer of", "executive officers"),
    ("DIRECTOR_OF", "Person", "Company", "sits on the board of", "board directors"),
    ("OFFERS", "Company", "Product", "offers", "vendors offering it"),
    ("INCORPORATED_IN", "Company", "Location", "is incorporated in", "companies incorporated there"),
    ("OPERATES_IN", "Company", "Location", "has operations in", "companies with operations there"),
    ("REGULATED_BY", "Company", "Regulator", "is regulated by", "companies it regulates"),
    ("EXPOSED_TO", "Company", "RiskTopic", "is exposed to the risk of", "companies disclosing it as a material risk"),
    ("PARTY_TO", "Company", "LegalProceeding", "is a party to", "named parties"),
)
#: What each relation states, for whoever extracts it.
DEFINITIONS = {
    "SUBSIDIARY_OF": "the object owns or controls the subject",
    "ACQUIRED": "the subject bought the object or merged with it",
    "COMPETES_WITH": "the text names the object among the subject's competitors",
    "SUPPLIES": "the subject sells parts, materials, rights or services to the object, which uses them",
    "PARTNERS_WITH": "the two have an alliance, licence or venture that the text names",
    "AUDITED_BY": "the object's accountants audit the subject",
    "OFFICER_OF": "the person holds an executive office there",
    "DIRECTOR_OF": "the person has a seat on that board, of the filer or of any other company",
    "OFFERS": "the object is a product or service that the subject sells under its name",
    "INCORPORATED_IN": "the state or country under whose law the subject exists",
    "OPERATES_IN": "the subject has sites, staff or much of its sales there",
    "REGULATED_BY": "a public body with power over the subject",
    "EXPOSED_TO": "the text states the topic as a material risk of the subject",
    "PARTY_TO": "the subject is a named party of the suit or investigation",
}
RISK_TOPICS = (
    "supply chain concentration",
    "customer concentration",
    "export controls and trade restrictions",
    "geopolitical tension",
    "intellectual property litigation",
    "cybersecurity incident",
    "talent retention",
    "manufacturing yield and capacity",
    "raw material and energy cost",
    "demand cyclicality",
    "foreign exchange",
    "environmental and climate regulation",
    "antitrust and competition regulation",
    "data privacy regulation",
    "acquisition integration",
)
ONTOLOGY = "predicate string, subject_type string, object_type string, phrase string, noun string"


def ontology(spark: SparkSession, relations=RELATIONS) -> DataFrame:
    """The vocabulary as a table; a few rows, so joins with it are broadcast."""
    return spark.createDataFrame(list(relations), ONTOLOGY)


def closed(value: str, allowed) -> str:
    """value, if the vocabulary has it, exactly so written. Plans are built from no other predicate."""
    if value not in allowed:
        raise ValueError(f"not in the vocabulary: {value!r}")
    return value


def struct_of(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)
