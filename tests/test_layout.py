import pathlib
import re

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_the_library_does_not_import_the_text_operators():
    for p in (ROOT / "seriesloom").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"seriesloom\.llm|corpus_pipeline", p.read_text()), p


def test_no_local_checkpoints():
    for p in (ROOT / "seriesloom").rglob("*.py"):
        assert "localCheckpoint" not in p.read_text(), p
