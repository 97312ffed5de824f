"""What stands without the optional subpackage, and the commands."""

import json
import os
import shutil
import subprocess
import sys
from pathlib import Path

from chatloom import cli

ROOT = Path(__file__).resolve().parents[1]


def test_the_rest_imports_without_the_optional_subpackage(tmp_path):
    shutil.copytree(ROOT / "chatloom", tmp_path / "chatloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True).stdout.split()
    assert "conversation_markdown" in said and "claude_payloads" in said
    assert not [n for n in said if n.startswith("op") or n == "pipeline"]


def test_nothing_else_imports_the_optional_subpackage():
    for module in ROOT.glob("chatloom/**/*.py"):
        if "llm" not in module.relative_to(ROOT).parts:
            assert ".llm" not in module.read_text(), module


def test_commands(spark, tmp_path, capsys):
    good = '---\nstatus: raw\nneeds_media: false\nplatform: "{0}"\nsource_url: "https://claude.ai/chat/1"\nconversation_id: "c1"\n---\n\n# T\n\n## Metadata\n\n- Needs media: false\n\n## Message 1 - User\n\nq\n\n## Message 1 - Assistant\n\na\n'
    for platform in ("ChatGPT", "Claude", "Gemini"):
        (tmp_path / "in" / platform).mkdir(parents=True)
        (tmp_path / "in" / platform / "talk.md").write_text(good.format(platform))
    folder = str(tmp_path / "in")
    assert cli.main(["check", folder, "--allow-partial"]) == 0 and "3 files checked, 0 failures" in capsys.readouterr().out
    assert cli.main(["check", folder]) == 1 and "no export of Grok" in capsys.readouterr().out
    (tmp_path / "in" / "Claude" / "untitled.md").write_text("nothing")
    assert cli.main(["check", folder, "--allow-partial"]) == 1
    said = capsys.readouterr().out
    assert "Claude/untitled.md: " in said and "filename is still untitled" in said
    assert cli.main(["index", folder, str(tmp_path / "out" / "index.json")]) == 0
    snapshot = json.loads((tmp_path / "out" / "index.json").read_text())
    assert [f["relativePath"] for f in snapshot["files"]] == ["ChatGPT/talk.md", "Claude/talk.md", "Claude/untitled.md", "Gemini/talk.md"]
    assert snapshot["files"][0]["metadata"]["conversationId"] == "c1" and snapshot["version"] == 1
    assert cli.main(["check", str(tmp_path / "nowhere")]) == 1
