"""The registered queries against their SQL, and the result schemas that are promised."""

import importlib
import os
import subprocess
import sys

import pytest

import __spark_entry__ as E
from oracle import compare, duck
from stationflow.llm import queries

SF = "/root/testdata/sf0.001"
SCHEMAS = {
    "op1_language_id": "doc_id long, held_out boolean, lang_pred string, score double",
    "op3_secret_scan": "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string",
    "op4_near_embeddings": "vec_id long, n_links long, component_id long, kept boolean",
    "op5_bpe": "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
    "op6_token_files": "doc_id long, start long, n_tokens long, ids_crc32 long",
    "op7_topk": "query_id long, rank int, vec_id long, score long",
    "op8_simhash": "doc_id long, fingerprint string, component_id long",
    "op9_toxicity": "doc_id long, held_out boolean, score double, predicted int",
    "op11_lm_scoring": "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    "op12_alignment": "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string",
    "op13_code_compression": "vec_id long, code string, error long, label_error long, codebooks_sha256 string",
    "op10_packing": "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
}


@pytest.mark.parametrize("key", sorted(queries.ORACLE))
def test_key_matches_oracle(spark, key):
    ok, msg = compare(E.queries()[key](spark, SF).toPandas(), duck(E.oracle_sql()[key], SF))
    assert ok, msg


@pytest.mark.parametrize("key", sorted(SCHEMAS))
def test_schema(spark, key):
    found = {f.name: f.dataType.simpleString() for f in E.queries()[key](spark, SF).schema.fields}
    want = dict(c.split(" ") for c in SCHEMAS[key].split(", "))
    assert want.items() <= {k: v.replace("bigint", "long") for k, v in found.items()}.items()


def test_all_and_the_pipeline_are_registered():
    numbers = sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES)
    assert numbers == list(range(1, 14)) and "pipeline" in E.queries()


def test_nothing_else_imports_the_subpackage():
    root = os.path.dirname(os.path.abspath(E.__file__))
    for folder, _, names in os.walk(os.path.join(root, "stationflow")):
        if "llm" not in folder.split(os.sep):
            for name in names:
                if name.endswith(".py"):
                    with open(os.path.join(folder, name)) as f:
                        assert "llm" not in f.read(), name


def test_the_rest_works_without_it(tmp_path):
    root = os.path.dirname(os.path.abspath(E.__file__))
    os.symlink(os.path.join(root, "__spark_entry__.py"), tmp_path / "__spark_entry__.py")
    os.mkdir(tmp_path / "stationflow")
    for name in os.listdir(os.path.join(root, "stationflow")):
        if name != "llm":
            os.symlink(os.path.join(root, "stationflow", name), tmp_path / "stationflow" / name)
    os.mkdir(tmp_path / "stationflow" / "llm")  # an empty folder may stay behind
    code = "import sys; sys.path.insert(0, sys.argv[1]); import importlib.util as u; s = u.spec_from_file_location('e', sys.argv[1] + '/__spark_entry__.py'); m = u.module_from_spec(s); sys.path_hooks; exec(open(s.origin).read().replace('os.path.dirname(os.path.abspath(__file__))', 'sys.argv[1]'), m.__dict__); print(sorted(m.queries()))"
    out = subprocess.run([sys.executable, "-c", code, str(tmp_path)], capture_output=True, text=True, cwd=tmp_path)
    assert out.returncode == 0, out.stderr
    assert "op1_" not in out.stdout and "pipeline" not in out.stdout and "broken_docks" in out.stdout
    importlib.invalidate_caches()
