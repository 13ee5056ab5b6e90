import pytest

from cairn.config import load_config, resolved, strategy_rows


def test_overrides_and_paths(tmp_path):
    (tmp_path / "configs").mkdir()
    (tmp_path / "configs/default.yaml").write_text("llm: {model: a, cache_namespace: n}\nstrategies:\n  X: {use_hybrid: true, rerank: false, decompose: false, final_k: 5}\n")
    assert load_config(root=tmp_path, environ={})["llm"] == {"model": "a", "cache_namespace": "n"}
    own = load_config(root=tmp_path, environ={"CAIRN_LLM_MODEL": "b", "CAIRN_CACHE_NAMESPACE": ""})
    assert own["llm"] == {"model": "b", "cache_namespace": "n"} and strategy_rows(own) == [("X", True, False, False, 5)]
    (tmp_path / "other.json").write_text('{"llm": {}}')
    assert load_config(root=tmp_path, environ={"CAIRN_CONFIG": "other.json"}) == {"llm": {}}
    assert str(resolved("/abs/x", tmp_path)) == "/abs/x"


def test_a_file_without_llm_is_an_error(tmp_path):
    (tmp_path / "bad.yaml").write_text("llm: text\n")
    with pytest.raises(ValueError):
        load_config("bad.yaml", tmp_path, {})
