"""The folder reader on real trees."""

from __future__ import annotations

import os

import pytest

from quern.sources import folders


@pytest.fixture
def tree(tmp_path):
    files = {
        ".gitignore": "*.log\n/only_top.py\ndraft/\n# comment\n!keep.log\nsub/**/deep.py\n\\#odd.py\n[ab]x.py\ntrail.py   \n",
        "a.py": "x = 1\n", "only_top.py": "x", "src/only_top.py": "x = 2\n", "b.log": "x", "keep.log": "x", "README.md": "# r\n",
        "src/.gitignore": "!b.log\n/local.py\ngen/\n", "src/b.log": "y", "src/local.py": "x", "src/in/local.py": "x = 3\n", "src/gen/g.py": "x",
        "draft/d.py": "x", "src/draft/d.py": "x", "drafts/d.py": "x = 4\n", "node_modules/m.js": "x", "src/vendor/v.go": "x", ".hidden/h.py": "x", "src/.env": "x",
        "sub/one/two/deep.py": "x", "sub/deep.py": "x", "sub/one/flat.py": "x = 5\n", "#odd.py": "x", "ax.py": "x", "cx.py": "x = 6\n", "trail.py": "x", "empty.py": "", "w.min.js": "x", "long.js": "y" * 6000, "bin.py": b"\xff\xfe", "large.py": "x\n" * (1 << 20), ".git/config": "x", "d1/d2/d3/z.ts": "let z\n",
    }
    for path, text in files.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(text if isinstance(text, bytes) else text.encode())
    os.symlink(tmp_path / "src", tmp_path / "d1" / "loop")
    return tmp_path


KEPT = ["README.md", "a.py", "bin.py", "cx.py", "d1/d2/d3/z.ts", "drafts/d.py", "long.js", "src/in/local.py", "src/only_top.py", "sub/one/flat.py"]


@pytest.mark.parametrize("partitions", [1, 4, 64])
def test_workspace(spark, tree, partitions):
    assert sorted(r.path for r in folders.workspace(spark, str(tree), partitions=partitions).collect()) == KEPT
    rows = folders.workspace(spark, f"file://{tree}", content=True, partitions=partitions).collect()
    assert sorted(r.path for r in rows) == [p for p in KEPT if p not in ("bin.py", "long.js")]
    assert all(r.content == (tree / r.path).read_text() and r.size == len(r.content) and r.modified for r in rows)


def test_files_outside_the_index(spark, tree):
    """A rule of a lower folder takes back what a higher one ignored."""
    assert sorted(r.path for r in folders.read(spark, str(tree)).where("path like '%.log'").collect()) == ["keep.log", "src/b.log"]


def test_what_is_ruled_out_is_not_opened(spark, tree):
    reader = folders.FolderReader({"path": str(tree), "partitions": "1", "content": "true"})
    seen = []
    inner = reader._list
    reader._list = lambda store, base, part: seen.append(part.folder) or inner(store, base, part)
    assert [r for p in reader.partitions() for r in reader.read(p)]
    assert sorted(set(seen)) == ["", "d1/", "d1/d2/", "d1/d2/d3/", "drafts/", "src/", "src/in/", "sub/", "sub/one/", "sub/one/two/"]
    many = folders.FolderReader({"path": str(tree), "partitions": "5"}).partitions()
    assert len(many) >= 5 and len({p.folder for p in many}) == len(many)


def test_listing(spark, tree):
    rows = {r.path: r.size for r in folders.listing(spark, str(tree)).collect()}
    assert rows["src/"] is None and rows["a.py"] == 6 and rows[".hidden/h.py"] == 1 and rows["draft/d.py"] == 1
    assert not any(p.startswith((".git/", "node_modules", "d1/loop")) for p in rows)
    deep = tree / "/".join(["n"] * 60)
    deep.mkdir(parents=True)
    assert max(r.path.rstrip("/").count("/") for r in folders.listing(spark, str(tree)).collect()) == 50
    (tree / "nothing").mkdir()
    assert folders.listing(spark, str(tree / "nothing")).count() == 0
