import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.llm import chat, queries

TURNS = "conv_id long, turn long, role string, text string, score string"


def back(df):
    made = chat.read_back(F.col("formatted"), F.col("loss_mask"))
    return df.select("tree", "branch", "formatted", made["turns"].alias("turns"), made["loss_text"].alias("loss")).collect()


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<s>", "a\\b", ""]), st.text(alphabet="<>/s[]INST\\ \né😀", max_size=25)), min_size=1, max_size=6))
def test_any_text_survives(spark, turns):
    df = spark.createDataFrame([(1, i, r, t, None) for i, (r, t) in enumerate(turns)], TURNS)
    (row,) = back(chat.format_trees(chat.reply_tree(df)))
    assert [(t.role, t.text) for t in row.turns] == turns
    assert row.loss == "".join(t for r, t in turns if r == "assistant")
    assert row.formatted.count("<s>") == row.formatted.count("</s>") == row.formatted.count("[INST]") == len(turns)


def test_edges(spark):
    rows = [(1, 0, None, None), (1, 0, "assistant", "b"), (1, None, "user", "first"), (None, 3, "user", "x"), (2, 5, "user", "same"), (2, 5, "user", "same")]
    got = {r.tree: r for r in back(chat.format_trees(chat.reply_tree(spark.createDataFrame([(*r, "s") for r in rows], TURNS))))}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", "first"), ("", ""), ("assistant", "b")]
    assert len(got[2].turns) == 2 and [t.text for t in got[None].turns] == ["x"]
    assert chat.format_trees(chat.reply_tree(spark.createDataFrame([], TURNS))).count() == 0


def test_branches_are_ranked_by_score(spark):
    tree = [("r", None, "user", "q", 0.0), ("a", "r", "assistant", "bad", 0.1), ("b", "r", "assistant", "good", 0.9), ("c", "b", "user", "more", 0.8), ("d", "c", "assistant", "deep", 0.7), ("e", "gone", "user", "orphan", 0.0)]
    df = spark.createDataFrame([(n, p, "t", r, x, s) for n, p, r, x, s in tree], "node string, parent string, tree string, role string, text string, score double")
    got = {r.branch: [t.text for t in r.turns] for r in back(chat.format_trees(df, branches=9))}
    assert got[1] == ["q", "good", "more", "deep"] and sorted(map(tuple, got.values())) == [("orphan",), ("q", "bad"), ("q", "good", "more", "deep")]
    assert [len(r.turns) for r in back(chat.format_trees(df, branches=1))] == [4]


def test_long_thread(spark):
    n = 300
    df = spark.createDataFrame([(1, i, "assistant" if i % 2 else "user", f"m{i}", None) for i in range(n)], TURNS)
    (row,) = back(chat.format_trees(chat.reply_tree(df)))
    assert [t.text for t in row.turns] == [f"m{i}" for i in range(n)]


def test_query(spark, sf):
    rows = {r.conv_id: r for r in queries.op2_chat_format(spark, sf).collect()}
    said = "</s>[INST] ok [/INST]"
    assert rows[-1].turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert (rows[-1].loss_chars, rows[-1].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    turns = {}
    for r in sorted(spark.read.parquet(f"{sf}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn)):
        turns.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    assert set(rows) == {*turns, -1}
    for k, t in turns.items():
        assert rows[k].n_turns == len(t) and rows[k].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in t).encode()).hexdigest()
        assert rows[k].loss_sha256 == hashlib.sha256("".join(b for a, b in t if a == "assistant").encode()).hexdigest()


TREE = "node string, parent string, tree string, role string, text string, score double"


def test_cycles_are_cut_and_repeated_nodes_count_once(spark):
    rows = [("a", "b", "t", "user", "A", 1.0), ("b", "a", "t", "assistant", "B", 1.0), ("c", "b", "t", "user", "C", 3.0), ("r", None, "u", "user", "R", 1.0), ("r", None, "u", "user", "R", 1.0), ("s", "r", "u", "assistant", "S", 1.0), ("x", "x", "v", "user", "X", 1.0)]
    got = {(r.tree, r.branch): r.formatted for r in chat.format_trees(spark.createDataFrame(rows, TREE), branches=5).collect()}
    turn = lambda role, text: f"<s>[INST] {role} [/INST]{text}</s>"
    assert got == {("t", 1): turn("user", "A") + turn("assistant", "B") + turn("user", "C"), ("u", 1): turn("user", "R") + turn("assistant", "S"), ("v", 1): turn("user", "X")}
