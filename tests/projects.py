"""Small projects and what the analysis must find in them."""

A_B = {"src/web/a.py": "from web import b\n", "src/web/b.py": "from web import a\n"}
TINY = {"src/a.py": "from . import b\n", "src/b.py": "from . import c\n", "src/c.py": "from . import a\n"}
MULTI = {
    "src/auth/a.py": "from auth import b\n", "src/auth/b.py": "from auth import a\n",
    "src/auth/c.py": "import models.x\n", "src/models/x.py": "import auth.c\n",
}
BRANCH = {
    "src/web/__init__.py": "# package\n", "src/web/core_a.py": "from web import core_b\n", "src/web/core_b.py": "from web import core_a\n",
    "src/web/mid.py": "\nfrom web import core_a\n", "src/web/entry.py": "from web import mid\n", "src/web/isolated.py": "",
}
SELF_INIT = {"src/kit/__init__.py": "from kit.child import x\n", "src/kit/child.py": "\nfrom . import sibling\n", "src/kit/sibling.py": ""}
IGNORE_DIRS = {
    "src/web/protos/x.py": "from web.protos import y\n", "src/web/protos/y.py": "from web.protos import x\n",
    "src/web/foo.py": "from web.protos import z\n", "src/web/protos/z.py": "from web import foo\n",
}
#: A loop of five files that only an edge to a package on the way closes.
MIXED = {
    "src/shop/__init__.py": "from .maker import Maker\n", "src/shop/maker.py": "from .stock import Source\n",
    "src/shop/stock/__init__.py": "from .source import Source\n", "src/shop/stock/source.py": "from yard.deal import Deal\n",
    "src/shop/stock/parts/base.py": "class Part:\n    pass\n", "src/yard/deal.py": "from shop.stock.parts.base import Part\n",
}
STRINGS = {
    "src/our/kit/a.py": "from . import b\n", "src/our/kit/b.py": 'import importlib\nX = importlib.import_module("our.kit.a")\nY = "no.such.name"\n',
    "src/our/kit/c.py": 'import importlib\nA = importlib.import_module("our.kit.d")\nB = "our.kit.b"\nC = importlib.import_module("our.kit.c")\nD = f"{importlib.import_module(\'our.kit.e\')}"\n',
    "src/our/kit/d.py": 'import importlib\ndef late():\n    return importlib.import_module("our.kit.c")\n', "src/our/kit/e.py": "",
}


def write(root, files: dict[str, str], config: str | None = 'source-roots = ["src"]\n'):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    if config is not None:
        (root / "knotwork.toml").write_text(config)
    return root
