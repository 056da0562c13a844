import pytest

from tessera.settings import Settings, as_toml, load, normalise_content, require_indexed


def test_layers_and_types(tmp_path):
    user, repo = tmp_path / "user.toml", tmp_path / "repo.toml"
    user.write_text("candidate_depth = 10\n[embedding]\nembed_dims = 32\n")
    repo.write_text("candidate_depth = 20\n")
    got = load(user, repo, {"TESSERA_RERANK": "no", "TESSERA_TEST_MARKERS": "check, it"}, window_chars=100)
    assert (got.candidate_depth, got.embed_dims, got.rerank, got.test_markers, got.window_chars) == (20, 32, False, ("check", "it"), 100)


@pytest.mark.parametrize("text", ["no_such_key = 1", "embed_api_key = 'x'"])
def test_repository_file_is_checked(tmp_path, text):
    path = tmp_path / "repo.toml"
    path.write_text(text)
    with pytest.raises(ValueError):
        load(None, path, {})


def test_content():
    s = Settings()
    assert normalise_content(None, s) == ("docs", "config", "tests", "code")
    assert normalise_content(["all", "data"], s) == ("docs", "config", "data", "tests", "code")
    with pytest.raises(ValueError):
        normalise_content("nothing", s)
    with pytest.raises(LookupError):
        require_indexed("data", s)


def test_toml_round_trip(tmp_path):
    path = tmp_path / "all.toml"
    path.write_text(as_toml(Settings(candidate_depth=7)))
    assert load(path, None, {}).candidate_depth == 7 and "embed_api_key" not in path.read_text()
    assert Settings(window_chars=1).identity()["chunking"] != Settings().identity()["chunking"]
