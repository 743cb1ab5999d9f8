"""Workers get the package wherever the session was started."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
#: The scanner is pickled by reference, so a worker has to import its module.
PROGRAM = f"""
import sys
sys.path.insert(0, {ROOT!r})
from quillgraph.runtime import session, ship
from quillgraph.streaming.claims import ClaimScanner
spark = session("2")
for _ in range(2):
    ship(spark)
assert spark.sparkContext._python_includes == ["quillgraph.zip"]

def run(batches, scanner=ClaimScanner):
    for batch in batches:
        assert scanner().feed('{{"claims": [{{"a": 1}}') == [{{"a": 1}}]
        yield batch

print("rows", spark.range(10).mapInArrow(run, "id long").count())
"""


def test_from_a_foreign_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", PROGRAM], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "rows 10" in done.stdout, done.stderr[-2000:]


def test_settled_leaves_its_result_alone(spark):
    """Tables that were written on the way are gone, those of before stay."""
    import os

    from quillgraph.runtime import materialize, settled, shared_dir

    here = shared_dir(spark).removeprefix("file:")
    before = materialize(spark.range(5), "before")
    known = set(os.listdir(here))

    def make():
        inner = settled(lambda: materialize(before.filter("id > 1"), "deep"), spark, "inner")
        return materialize(inner, "step").join(before, "id")

    found = settled(make, spark, "found")
    assert sorted(r.id for r in found.collect()) == [2, 3, 4] and before.count() == 5
    assert [x.split("-")[0] for x in set(os.listdir(here)) - known] == ["found"]
    with_error = set(os.listdir(here))
    try:
        settled(lambda: 1 / 0, spark)
    except ZeroDivisionError:
        pass
    materialize(spark.range(1), "after")
    assert {x.split("-")[0] for x in set(os.listdir(here)) - with_error} == {"after"}
