import pytest

from siltgate import config, schema

OLDEST = """# policy
comment_language:
  required_language: ko  # keep
  min_length: 5
  file_languages:
    - pattern: "*.md"
commit_message:
  no_coauthor: true
  language_check:
    required_language: en
"""


def test_versions():
    cases = {
        "v1.0.0": [OLDEST, "", "comment_language:\n  locale: en\n", "preset:\n  url: x\n"],
        "v1.0.1": [OLDEST + "lint:\n  yaml:\n    enabled: true\n", "commit_message:\n  no_coauthor: true\n  no_emoji: null\n", "editorconfig: {}\n"],
        "v1.0.2": ["commit_message:\n  no_ai_coauthor: true\n  language_check:\n    required_language: ko\n"],
        "v1.1.0": ["comment_language:\n  required_language: ko\n  allowed_words: [a]\n", "encoding:\n  no_invisible_chars: true\ncomment_language:\n  required_language: en\n"],
        "v1.2.0": ["commit_message:\n  language_check:\n    locale: ko\n", "encoding:\n  locale: ko\n", "comment_language:\n  file_languages:\n    - pattern: x\n      locale: en\n"],
        "unknown": ["surely_unknown: 1\n", ":::no: [yaml", "- a\n", "comment_language:\n  min_length: five\n", "comment_language:\n  languages: [1]\n", "commit_message:\n  no_coauthor: true\n  no_ai_coauthor: true\n", "lint: 3\n"],
    }
    for name, docs in cases.items():
        for doc in docs:
            assert schema.detect_version(doc) == name, doc


def test_migrations():
    new, told = schema.migrate(OLDEST)
    assert new == OLDEST.replace("required_language", "locale").replace("no_coauthor", "no_ai_coauthor") and len(told) == 2
    # a current document stays; one that was brought up to date has nothing more to rename
    current = "encoding:\n  locale: ko\n"
    assert schema.migrate(current) == (current, []) and schema.migrate(new)[0] == new
    both = "comment_language:\n  locale: en\n\n  # old\n  required_language: ko\n  file_languages:\n    - pattern: a\n      language: ko\n"
    assert schema.migrate(both)[0] == "comment_language:\n  locale: en\n\n  # old\n  file_languages:\n    - pattern: a\n      locale: ko\n"
    with pytest.raises(ValueError):
        schema.migrate("unknown_key: 1\n")


def test_presets_do_not_nest(tmp_path):
    (tmp_path / "p.yml").write_text("preset:\n  path: other.yml\n")
    (tmp_path / "q.yml").write_text("commit_message:\n  no_emoji: true\n")
    with pytest.raises(ValueError):
        config.with_includes({"preset": {"path": "p.yml"}}, str(tmp_path), str(tmp_path))
    assert config.with_includes({"preset": {"path": "q.yml"}}, str(tmp_path), str(tmp_path))["commit_message"] == {"no_emoji": True}
