import pytest
from pyspark.sql import functions as F

from quillgraph.functions import text as X
from quillgraph.operators import chunking, validate
from quillgraph.schemas import RELATIONS, closed, ontology


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "name,norm",
    [
        ("Blue River Corp.", "blue river"),
        ("Blue River Corporation", "blue river"),
        ("BLUE RIVER INC /DE", "blue river"),
        ("Stone & Sons, Ltd.", "stone and sons"),
        ("Groß Werke AG", "gross werke"),
        ("Delta N.V.", "delta"),
        ("The X", "x"),
        ("Ünal Holding S.A.", "ünal"),
        ("Inc.", ""),
    ],
)
def test_normalize(spark, name, norm):
    assert one(spark, name, X.normalize) == norm


def test_acronyms(spark):
    assert one(spark, "blue river mining", X.acronym) == "brm"
    assert one(spark, "blue", X.acronym) == ""
    assert one(spark, "Blue River Mining Company", X.raw_acronym) == "brmc"


def test_blocking_keys(spark):
    df = spark.createDataFrame([("brmc", "BRMC"), ("blue river mining", "Blue River Mining Company")], "norm string, surface string")
    keys = [set(r.k) for r in df.select(X.blocking_keys("norm", "surface").alias("k")).collect()]
    assert keys[0] & keys[1] == {"acr:brmc"} and "pre:blue" in keys[1]


@pytest.mark.parametrize("text,numbers", [("It has nine and 12 of 1,234.", [9, 12, 1234]), ("Twenty items; none", [20]), ("no figures", []), ("007 x7", [7])])
def test_stated_numbers(spark, text, numbers):
    assert one(spark, text, X.stated_numbers) == numbers


def test_names_it_needs_whole_tokens(spark):
    df = spark.createDataFrame([("It is Blue River, Inc. here", ["blue river"]), ("It is Blueish River", ["blue river"]), ("x", [""])], "x string, forms array<string>")
    assert [r.y for r in df.select(X.names_it("x", "forms").alias("y")).collect()] == [True, False, False]


def test_clean_and_squash(spark):
    assert one(spark, " a \t b\nTable of Contents\nc\n\n\n\nd ", X.clean) == "a b\nc\n\nd"
    assert one(spark, None, X.clean) == ""
    assert one(spark, " A b\n C ", X.squash) == "a b c"


def test_alias_declaration(spark):
    pairs = one(spark, 'We, Blue River Mining, Inc. ("Blue") and others.', X.alias_pairs)
    assert [p.short for p in pairs] == ["Blue"]
    pairs = one(spark, "At Blue River Mining (Blue) and Île Zürich Énergie Works (Works), not lower case (Case).", X.alias_pairs)
    assert [(p.long, p.short) for p in pairs] == [("At Blue River Mining", "Blue")]
    pairs = one(spark, "by Alpha Zürich Énergie (“Alpha”) and Alpha Zür&Co. Works ( Works )", X.alias_pairs)
    assert [(p.long, p.short) for p in pairs] == [("Alpha Zür&Co. Works", "Works")]
    df = spark.createDataFrame([("Blue River Mining", "Blue"), ("Blue River Mining", "BRM"), ("Blue River Mining", "Green")], "l string, s string")
    assert [r.y for r in df.select(X.declares("l", "s").alias("y")).collect()] == [True, True, False]


def test_citation_and_plural(spark):
    assert one(spark, " [ab12] ", X.bare_citation) == "ab12"
    assert one(spark, "Company", X.plural) == "Companies" and one(spark, "Person", X.plural) == "Persons"
    assert one(spark, "a+b:(c)", X.query_words).split() == ["a", "b", "c"]


def test_ids_depend_on_place_alone(spark):
    a = spark.range(1).select(X.digest(F.lit("x"), F.lit("y"), F.lit("0")).alias("i")).first().i
    assert a == spark.range(1).select(X.digest(F.lit("x"), F.lit("y"), F.lit("0")).alias("i")).first().i and len(a) == 16


def test_split_covers_and_overlaps():
    text = "\n\n".join(f"{i} " + "word " * 120 for i in range(40))
    parts = chunking.split(text)
    assert all(len(p) <= 4802 for p in parts) and all(any(f"{i} word" in p for p in parts) for i in range(40))
    assert parts[1].startswith(parts[0][-800:])


@pytest.mark.parametrize(
    "text,chunks",
    [
        ("Alpha \n\n  Beta", ["Alpha \n\n  Beta"]),  # paragraphs stay as they are
        ("a" * 10 + "\n\n" + "b" * 8 + "\n \n\ncc", ["a" * 10 + "\n\n" + "b" * 8, "bbbbb\n\ncc"]),  # 12 + 8 fit into 20, 22 + 2 don't
        ("a" * 10 + "\n\n" + "b" * 9 + "\n\n\n", ["a" * 10, "aaaaa\n\n" + "b" * 9]),
        ("q\n\n" + "x" * 18 + "y" * 12 + "\n\nzzz\n\nw", ["q", "x" * 18 + "yy", "xxx" + "y" * 12 + "\n\nzzz", "\n\nzzz\n\nw"]),
        ("x" * 20 + "\n\n" + "y" * 20, ["x" * 20, "xxxxx\n\n" + "y" * 20]),
    ],
)
def test_split_by_hand(text, chunks):
    assert chunking.split(text, 20, 5) == chunks


def test_split_long_paragraph():
    text = "".join(chr(97 + i % 26) for i in range(10_000))
    parts = chunking.split("short one\n\n" + text)
    assert parts[0] == "short one"  # closed, and not carried into the heads
    assert parts[1] == text[:4000] and parts[2] == text[3200:7200] and parts[3] == text[6400:]
    assert chunking.split("") == [] and chunking.split("\n \n\n") == []


def test_ordinals_count_before_filters(spark):
    docs = spark.createDataFrame([("a", "x" * 5000 + "\n\n" + "y" * 100), ("b", None)], "k string, text string")
    rows = chunking.chunk(docs, ["k"]).orderBy("ordinal").collect()
    assert [r.ordinal for r in rows] == [0, 1] and len({r.chunk_id for r in rows}) == 2


def test_keep(spark):
    rows = [("p" * 400, False, True), ("p" * 100, False, False), ("p" * 400, True, False), ("served as a director since. " + "w" * 300, True, True), ("director of " + "1 2 " * 200, True, False)]
    df = spark.createDataFrame([(a, b) for a, b, _ in rows], "t string, p boolean")
    assert [r.y for r in df.select(chunking.keep("t", F.col("p")).alias("y")).collect()] == [c for *_, c in rows]


def extraction(spark, relation, mentions=(("Blue", "Company"), ("Green", "Company"), ("Ann", "Person"), ("storms", "RiskTopic"))):
    row = ("c1", "Blue supplies\n  Green with ore.", [tuple(m) for m in mentions], [relation])
    kind = "chunk_id string, text string, mentions array<struct<name: string, type: string>>, relations array<struct<subject: string, predicate: string, object: string, confidence: string, evidence: string>>"
    return validate.reasons(validate.with_types(spark.createDataFrame([row], kind)), ontology(spark)).first().reason


@pytest.mark.parametrize(
    "relation,reason",
    [
        (("Blue", "SUPPLIES", "Green", "high", "blue SUPPLIES green"), None),
        (("Blue", "SUPPLIES", "Green", "high", ""), None),
        (("Blue", "SUPPLIES", "Nobody", "high", "x"), "unknown_endpoint"),
        (("Blue", "SUPPLIES", "Blue", "high", "x"), "self_loop"),
        (("Ann", "SUPPLIES", "Green", "high", "x"), "type_signature"),
        (("Blue", "SUPPLIES", "Green", "high", "Blue gives Green ore"), "evidence_not_found"),
        (("Blue", "EXPOSED_TO", "storms", "high", "ore"), "unknown_risk_topic"),
    ],
)
def test_first_reason(spark, relation, reason):
    assert extraction(spark, relation) == reason


def test_last_type_of_a_name_holds(spark):
    mentions = (("Blue", "Person"), ("Blue", "Company"), ("Green", "Company"))
    assert extraction(spark, ("Blue", "SUPPLIES", "Green", "high", ""), mentions) is None


@pytest.mark.parametrize("value", ["supplies", "", "SUPPLIES]->(x) DETACH DELETE x//", "X"])
def test_vocabulary_is_closed(value):
    with pytest.raises(ValueError):
        closed(value, [r[0] for r in RELATIONS])


@pytest.mark.parametrize("letters", [2_000_000, 12, 0])
def test_quoted(spark, monkeypatch, letters):
    """By one automaton, by several and runs, by as many as there can be."""
    monkeypatch.setattr(validate, "PATTERNS", max(letters, 1))
    texts = ["One  two three\nfour five six seven eight nine ten eleven.", "xone twoy", "ONE TWO", "", None, "nine", "three four", "a three four fi b"]
    quotes = ["e two three four five six seven eight nine t", "one two", "hree four f", "nine", "", None, "five four", "three four five six", "ne two three fou", "nine", "e two three four five six seven nine eight nine t"]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, "nine"), (5, "nine")]
    items = [(100 + i, t) for i, t in enumerate(quotes)] + [(None, "nine")]

    def flat(t):
        return " ".join(t.split()).lower()

    want = sorted((i, d) for i, q in items for d, t in docs if None not in (i, d, q, t) and flat(q) in flat(t))
    schema = "id long, text string, between string, quote string"
    frames = [spark.createDataFrame([(*r, "x", "y") for r in rows], schema).withColumnRenamed("id", name) for rows, name in ((docs, "doc_id"), (items, "item_id"))]
    assert sorted(map(tuple, validate.quoted(*frames).collect())) == want
    for empty in ((frames[0].limit(0), frames[1]), (frames[0], frames[1].limit(0))):
        assert validate.quoted(*empty).count() == 0


def test_folding_looks_for_no_long_class_of_letters(spark):
    """Texts are asked for one short class of letters only, and every letter that folds still does."""
    letters = [c for c in [*X._OTHER, *X._SEVERAL, "a", "Z", "é"]]
    folded = spark.createDataFrame([(c, f"Ab {c} {c}") for c in letters], "c string, t string").select("c", X.fold("t").alias("t"))
    assert {r.c: r.t for r in folded.collect()} == {c: f"ab {c.casefold()} {c.casefold()}" for c in letters}
    plan = folded._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan and X._OTHER[0] not in plan.split("RLIKE")[1].split(" THEN ")[0]
