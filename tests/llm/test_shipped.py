"""What workers get is enough to import every module of the package."""

import subprocess
import sys

from rangeloom.llm import common


def test_modules_import_from_the_zip(tmp_path):
    common.pack(tmp_path / "rangeloom.zip")
    names = ["anchors", "bpe", "decontam", "graph", "langid", "lm", "minhash", "quality", "rlz", "simhash", "suffix", "tokenfile"]
    code = "import sys; sys.path.insert(0, 'rangeloom.zip'); " + "; ".join(f"import rangeloom.llm.{n} as m; assert '.zip' in m.__file__" for n in names)
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": ""})
