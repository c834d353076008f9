import corpus_pipeline as cp
import duckdb

from packetflow.llm import decontaminate, near_dedup, registry, token_files
from packetflow.llm.quality_rules import ORACLE_SQL as RULES
from packetflow.llm.mixing import ORACLE_SQL as MIX
from packetflow.llm.decontaminate import ORACLE_SQL as CLEAN
from packetflow.session import settle
from tests.llm.test_near_dedup import brute

SF = "/root/testdata/sf0.001"


def test_stages_equal_sql_and_brute_force(spark):
    """Each stage against the SQL of its operator (or brute force) on its own input."""
    con = duckdb.connect()
    for name in ("labels", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in cp.STAGES:
        rows = docs.collect()
        held = docs.toPandas()
        con.register("documents", held)
        got = settle(stage(spark, docs, SF), name)
        if name != "token_files":
            assert got.columns == columns
        ids = sorted(r.doc_id for r in got.collect())
        if name == "quality_rules":
            want = [r[0] for r in con.execute(f"SELECT doc_id FROM ({RULES}) WHERE kept ORDER BY 1").fetchall()]
        elif name == "near_dedup":
            want = sorted(i for i, c in brute([(r.doc_id, r.text) for r in rows]).items() if i == c)
        elif name == "decontamination":
            want = [r[0] for r in con.execute(f"SELECT doc_id FROM ({CLEAN}) WHERE NOT contaminated ORDER BY 1").fetchall()]
        elif name == "mixing":
            want = [i for i, n in con.execute(f"SELECT doc_id, taken // size FROM ({MIX}) WHERE taken > 0 ORDER BY 1").fetchall() for _ in range(n)]
        else:
            want = sorted(r.doc_id for r in rows)
            tokenizer = token_files.piece_ids(token_files.tokenizer_path()).tokenizer
            assert sum(r.n_tokens for r in got.collect()) == sum(len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in rows)
        assert ids == want, name
        con.unregister("documents")
        docs = got


def test_every_operator_is_registered_once():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "near_dedup", "decontamination", "mixing", "token_files"]
    assert near_dedup.SIMILARITY == 0.8 and near_dedup.SHINGLE == 5 and decontaminate.WINDOW == 13
