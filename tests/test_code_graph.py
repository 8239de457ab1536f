import pytest

from lodestone.functions import code
from lodestone.operators import code_graph as C
from lodestone.operators import graph as G

FILES = {
    "shop/__init__.py": "",
    "shop/base.py": "class BaseValidator:\n    def check(self, x):\n        return bool(x)\n",
    "shop/validator.py": "from .base import BaseValidator\nimport json\n\nclass Validator(BaseValidator):\n    def validate(self, order):\n        return self.check(order)\n",
    "shop/orders.py": "from shop.validator import Validator\nfrom shop.notify import notify_user as tell\nimport yaml\nimport shop.gone\n\nclass OrderService:\n    def process_order(self, order):\n        v = Validator()\n        v.validate(order)\n        tell(order)\n        return self.done(order)\n\n    def done(self, order):\n        return order\n",
    "shop/notify.py": "def notify_user(order):\n    return helper(order)\n\ndef helper(x):\n    return x\n",
    "tests/test_orders.py": "from shop.orders import OrderService\n\ndef test_process():\n    OrderService().process_order(1)\n",
}


@pytest.fixture(scope="module")
def built(spark):
    rows = [(p, c, "python", len(c.splitlines())) for p, c in FILES.items()]
    files = spark.createDataFrame(rows, "relative_path string, content string, language string, line_count long")
    v, log = C.build(files, code.parse_symbols(files), code.parse_imports(files))
    return files, v.cache(), log.cache()


def pairs(log, kind):
    return {(r.src, r.dst) for r in log.where(f"edge_type = '{kind}'").collect()}


def test_edges(built):
    _, v, log = built
    assert pairs(log, "IMPORTS") == {
        ("file:shop/validator.py", "file:shop/base.py"), ("file:shop/orders.py", "file:shop/validator.py"), ("file:shop/orders.py", "file:shop/notify.py"),
        ("file:tests/test_orders.py", "file:shop/orders.py"),
    }
    assert pairs(log, "INHERITS") == {("class:shop/validator.py:Validator", "class:shop/base.py:BaseValidator")}
    calls = pairs(log, "CALLS")
    run = "method:shop/orders.py:OrderService.process_order"
    assert {(run, "class:shop/validator.py:Validator"), (run, "method:shop/validator.py:Validator.validate"), (run, "function:shop/notify.py:notify_user"), (run, "method:shop/orders.py:OrderService.done")} <= calls
    assert ("method:shop/validator.py:Validator.validate", "method:shop/base.py:BaseValidator.check") in calls
    assert ("function:shop/notify.py:notify_user", "function:shop/notify.py:helper") in calls
    assert {r.type: r.n for r in G.graph_summary(v, log).where("kind = 'node'").collect()} == {"file": 6, "class": 3, "method": 4, "function": 3}


def test_impact_and_targets(built):
    _, v, log = built
    rows = {r.node: r for r in C.blast_radius(v, G.last_edges(log), "function:shop/notify.py:helper").collect()}
    assert rows["function:shop/notify.py:notify_user"].tags == ["DIRECT_CALLER"] and rows["method:shop/orders.py:OrderService.process_order"].depth == 2
    assert rows["file:shop/orders.py"].tags == ["COARSE_FILE_DEPENDENT"]
    assert C.resolve_target(v, "shop/orders.py")["id"] == "file:shop/orders.py" and C.resolve_target(v, "orders.py::OrderService::done")["name"] == "done"
    assert C.resolve_target(v, "helper")["resolution_method"] == "name"
    with pytest.raises(LookupError, match="near.*helper"):
        C.resolve_target(v, "helpr")
    assert [r.name for r in G.search_nodes(v, "VALIDATOR", "class").collect()] == ["BaseValidator", "Validator"]


def test_categories_and_history(spark, built):
    files, v, log = built
    found = {r.statement: r.category for r in C.classify_imports(code.parse_imports(files), files, {"yaml"}).collect()}
    assert found["import json"] == "EXTERNAL_STDLIB" and found["import yaml"] == "EXTERNAL_MANIFEST" and found["import shop.gone"] == "UNRESOLVED_INTERNAL" and found["from .base import BaseValidator"] == "INTERNAL"
    commits = spark.createDataFrame([("h1", "h", 0)], "full_hash string, short_hash string, seq long")
    changes = spark.createDataFrame([("h1", "M", "shop/notify.py"), ("h1", "A", "old.py")], "full_hash string, status string, path string")
    couplings = spark.createDataFrame([("shop/notify.py", "shop/orders.py", 0.5), ("shop/base.py", "shop/notify.py", 0.4)], "item_a string, item_b string, jaccard double")
    v2, e2 = C.temporal(v, log, commits, changes, couplings)
    assert pairs(e2, "CHANGED_IN") == {("file:shop/notify.py", "commit:h1"), ("file:old.py", "commit:h1")}
    # An import stands from orders to notify, so only the other direction is added.
    assert pairs(e2, "CO_CHANGED_WITH") == {("file:shop/notify.py", "file:shop/orders.py"), ("file:shop/base.py", "file:shop/notify.py"), ("file:shop/notify.py", "file:shop/base.py")}
    assert v2.where("id = 'file:old.py'").count() == 1
