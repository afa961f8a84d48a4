import random

import pytest
from folioscope.operators import log
from folioscope.streaming.events import same_message
from pyspark.sql import functions as F

VALUES = ["Parsing (1 of 5) x", "Parsing (2 of 5) x", "Parsing 1 of 5 Incidents", "Parsing 3 of 5 Incidents", "Parsing Incidents", "Export a 1 of 2", "Export a", "Export b", "Parse q", "Update 1", "of x", "x of", "a  of  b", "1 of 2", "done", " of ", "of of of"]


def model_collapse(messages):
    kept = []
    for seq, method, value in messages:
        if method == "Progress" and kept and same_message(method, value, kept[-1][1], kept[-1][2]):
            kept[-1] = (seq, method, value)
        else:
            kept.append((seq, method, value))
    return kept


def model_depth(messages):
    offset, out = 0, []
    for seq, method, _ in messages:
        if method == "GroupEnd" and offset > 0:
            offset -= 1
        out.append((seq, offset))
        if method == "Group":
            offset += 1
    return out


def model_clear(messages, prefix):
    start = next((i for i, m in enumerate(messages) if m[1] == "Group" and m[2].startswith(prefix)), None)
    if start is None or any(m[1] == "GroupEnd" and m[2].startswith(prefix) for m in messages[start + 1 :]):
        return messages
    return messages[: start + 1]


@pytest.fixture(scope="module")
def logs(spark):
    r = random.Random(9)
    out = {}
    for k in range(150):
        out[k] = [(i, r.choice(log.METHODS + ("Progress",) * 5), r.choice(VALUES + ["g1", "g2", "g12"])) for i in range(r.randrange(1, 20))]
    df = spark.createDataFrame([(k, *m) for k, ms in out.items() for m in ms], "key int, seq long, method string, value string").repartition(3)
    return df.cache(), out


def by_log(rows, *cols):
    out = {}
    for r in sorted(rows, key=lambda r: (r.key, r.seq)):
        out.setdefault(r.key, []).append(tuple(r[c] for c in cols))
    return out


@pytest.mark.parametrize("stretch", [1, 3, 1000])
def test_collapse(logs, stretch):
    df, model = logs
    assert by_log(log.collapsed(df, ["key"], stretch).collect(), "seq", "method", "value") == {k: model_collapse(m) for k, m in model.items()}


@pytest.mark.parametrize("stretch", [1, 3, 1000])
def test_depth(logs, spark, stretch):
    df, model = logs
    assert by_log(log.with_depth(df, ["key"], stretch).collect(), "seq", "depth") == {k: model_depth(m) for k, m in model.items()}
    assert [r[0] for r in spark.range(3).select(log.indent(F.col("id")).alias("x")).collect()] == ["", "|", "||"]


@pytest.mark.parametrize("prefix", ["g1", "g2", "g", "nope", "g12\nmore"])
def test_clear(logs, prefix):
    df, model = logs
    assert by_log(log.cleared(df, ["key"], prefix).collect(), "seq", "method", "value") == {k: model_clear(m, prefix.split("\n")[0]) for k, m in model.items()}


@pytest.mark.parametrize("height", [0, 1, 4])
def test_tail(logs, height):
    df, model = logs
    assert by_log(log.tail(df, ["key"], height).collect(), "seq", "method", "value") == {k: m[-height:] if height else m for k, m in model.items()}


@pytest.mark.parametrize("errors,warnings", [(True, True), (False, True), (True, False), (False, False)])
def test_reset(logs, errors, warnings):
    df, model = logs
    keep = ({"Error"} if not errors else set()) | ({"Warn"} if not warnings else set())
    assert sorted((r.key, r.seq) for r in log.reset(df, errors, warnings).collect()) == sorted((k, m[0]) for k, ms in model.items() for m in ms if m[1] in keep)


def test_switches_lines_and_summary(logs, spark):
    df, model = logs
    on = {"Group": True, "Log": False, "Progress": True}
    assert {r.method for r in log.enabled(df, on).collect()} == {"Group", "GroupEnd", "Progress"}
    assert {r.key: (r.length, r.has_errors) for r in log.summary(df, ["key"]).collect()} == {k: (len(m), any(x[1] == "Error" for x in m)) for k, m in model.items()}
    one = spark.createDataFrame([(1, "a\n>b\n-c\n"), (2, "")], "seq long, value string")
    assert [(r.seq, r.line_no, r.line) for r in log.lines(one).orderBy("seq", "line_no").collect()] == [(1, 0, " a"), (1, 1, "->b"), (1, 2, "--c"), (1, 3, " "), (2, 0, " ")]
    assert one.select(log.message(one.value)).count() == 2


def test_the_repeat_rule_has_a_direction():
    assert same_message("Progress", "Parsing 1 of 5 Incidents", "Progress", "Parsing Incidents")
    assert not same_message("Progress", "Parsing Incidents", "Progress", "Parsing 1 of 5 Incidents")
    assert same_message("Log", "x", "Log", "x") and not same_message("Log", "Export a", "Log", "Export b")


def test_offset_and_console(spark):
    import io

    rows = [(1, 0, "Group", "g"), (1, 1, "Log", "a\n>b"), (1, 2, "GroupEnd", "g"), (1, 3, "GroupEnd", "g"), (1, 4, "GroupEnd", "g"), (1, 5, "Error", "bad"), (2, 0, "Log", "z")]
    df = spark.createDataFrame(rows, "user long, seq long, method string, value string")
    depths = {(r.user, r.seq): r.depth for r in log.with_depth(df, ["user"], stretch=2, offset=1).collect()}
    assert depths == {(1, 0): 1, (1, 1): 2, (1, 2): 1, (1, 3): 0, (1, 4): 0, (1, 5): 0, (2, 0): 1}
    with pytest.raises(ValueError):
        log.with_depth(df, ["user"], offset=-1)
    out, err = io.StringIO(), io.StringIO()
    assert log.to_console(df, ["user"], 5, 1, out, err) == 7
    assert err.getvalue() == " bad\n" and out.getvalue() == "|| a\n||->b\n| g\n g\n g\n| z\n"
