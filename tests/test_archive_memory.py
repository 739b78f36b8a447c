"""Archives are read in small blocks, whatever their length, and rows longer than a block come whole."""

import os
import subprocess
import sys
import zipfile

from airlake.sources import archives

ROW = "{state},13,1,{n},36.71,-96.71,24-HR BLK AVG,1996-03-01,Included,4,76,31.25,{name}\n"


def _archive(folder, rows):
    with zipfile.ZipFile(folder / "a.zip", "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z, z.open("a.csv", "w", force_zip64=True) as f:
        f.write((",".join(archives.DAILY) + "\n").encode())
        for r in rows:
            f.write(r.encode())


def test_rows_longer_than_a_block(tmp_path):
    names = {7: "x" * (3 << 20), 30_000: '"' + "y\n" * (9 << 19) + '"', 39_999: "z" * (20 << 20)}
    _archive(tmp_path, (ROW.format(state=n % 3, n=n, name=names.get(n, "site")) for n in range(40_000)))
    reader = archives.ArchiveReader(str(tmp_path), archives.DAILY)
    reader.only = {"0"}
    got = [(int(p), len(s)) for b in reader.read(reader.partitions()[0]) for p, s in zip(b.column("poc").to_pylist(), b.column("site_name").to_pylist())]
    assert got == [(n, len(names.get(n, "site").strip('"'))) for n in range(0, 40_000, 3)]


def test_a_long_file_takes_little_memory(tmp_path):
    _archive(tmp_path, (ROW.format(state=0, n=1, name="site") * 10_000 for _ in range(360)))  # 260 MB
    code = """import resource, sys
from airlake.sources import archives
r = archives.ArchiveReader(sys.argv[1], archives.DAILY)
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1e3
before = peak()
print(sum(b.num_rows for b in r.read(r.partitions()[0])), peak() - before)"""
    root = os.path.dirname(os.path.dirname(archives.__file__.removesuffix("/sources/archives.py") + "/"))
    said = subprocess.run([sys.executable, "-c", code, str(tmp_path)], env=os.environ | {"PYTHONPATH": os.path.dirname(root)}, capture_output=True, text=True, check=True).stdout.split()
    assert int(said[0]) == 3_600_000 and float(said[1]) < 250
