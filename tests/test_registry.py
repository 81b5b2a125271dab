import __spark_entry__ as entry


def test_names_and_oracles_match():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 80


def test_flagship_runs(spark):
    assert entry.entry(spark).limit(5).count() > 0


def test_core_stands_without_the_text_subpackage():
    import ast
    import os

    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "srcatlas")
    for at, _, names in os.walk(root):
        if os.sep + "llm" in at:
            continue
        for n in names:
            if n.endswith(".py"):
                with open(os.path.join(at, n), encoding="utf-8") as f:
                    for node in ast.walk(ast.parse(f.read())):
                        if isinstance(node, ast.ImportFrom):
                            assert "llm" not in (node.module or "").split(".") and not any(a.name == "llm" for a in node.names)
