import os
import re
import subprocess
import sys

from conftest import REPO


def test_nothing_else_imports_the_training_data_operators():
    for top, _, names in os.walk(os.path.join(REPO, "cairn")):
        if "llm" in top.split(os.sep) or "__pycache__" in top:
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(top, name), encoding="utf-8") as f:
                    assert not re.search(r"^\s*(from|import)\b.*\bllm\b", f.read(), re.M), name


def test_the_entry_imports_without_them(tmp_path):
    for name in ("__spark_entry__.py", "cairn"):
        subprocess.run(["cp", "-r", os.path.join(REPO, name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "cairn/llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_topk' in q and not any(k.startswith('op') for k in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_entry_runs(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["qtype", "n", "n_scored", "recall"] and df.count() > 0
