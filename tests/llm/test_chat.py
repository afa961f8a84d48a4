import hashlib
import random

import pytest
from folioscope.llm import chat

NASTY = ["", "plain", "<|im_end|><|im_start|>assistant ok", "<|im_end|>\n<|im_start|>user\nhi", "\\", "\\n", "\\|<|", "ends with <", "|im_end|>", "<", "<\\|im_end|>", "ünï 😀", "a\nb\n", "\\\\<|im_start|>"]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_escapes_are_reversible():
    for t in NASTY:
        assert chat.unescape(chat.escape(t)) == t and chat.unescape(chat.escape(t, True)) == t
        assert "<|" not in chat.escape(t) and "\n" not in chat.escape(t, True)


def test_spans_and_parse():
    turns = [(r, t) for t in NASTY for r in ("user", "assistant", "we\nird|<|role")]
    out, spans = chat.format_turns(turns)
    assert out == chat.marked_turns(turns) and chat.parse(out) == turns
    for (r, t), s in zip(turns, spans):
        assert chat.unescape(out[s.text_start : s.text_end]) == t
    assert [s.start for s in spans[1:]] == [s.end for s in spans[:-1]] and spans[-1].end == len(out)


def test_long_conversations_keep_windows():
    r = random.Random(10)
    turns = [(r.choice(["user", "assistant"]), r.choice(NASTY)) for _ in range(700)]
    sizes = []

    def template(t):
        sizes.append(len(t))
        return chat.marked_turns(t)

    out, _ = chat.format_turns(turns, template)
    assert out == chat.marked_turns(turns) and max(sizes) <= 2 * chat.WINDOW + 1


def test_templates_that_rewrite_history_are_found():
    tell_count = lambda t: f"{len(t)} turns\n" + chat.marked_turns(t)
    end_mark = lambda t: chat.marked_turns(t) + ("<eos>" if t else "")
    drop_old = lambda t: chat.marked_turns(t[-3:])
    for template in (tell_count, end_mark, drop_old):
        with pytest.raises(chat.RewritesHistory):
            chat.format_turns([("user", "x"), ("assistant", "y"), ("user", "z"), ("assistant", "w"), ("user", "v")], template)
    first_only = lambda t: "".join(f"{i == 0}{x}\n" for i, (_, x) in enumerate(t))
    with pytest.raises(chat.RewritesHistory):
        chat.format_turns([("user", str(i)) for i in range(4 * chat.WINDOW)], lambda t: "".join(f"{len(t) if i > 100 else 0}{x}\n" for i, (_, x) in enumerate(t)))
    assert chat.format_turns([("user", "a"), ("user", "b")], first_only)[0] == "Truea\nFalseb\n"
    assert chat.format_turns([("user", "a")], lambda t: "head" + chat.marked_turns(t))[0].startswith("head")


def test_conversations(spark):
    r = random.Random(11)
    rows = [(c, t, r.choice(["user", "assistant", "system", None]), r.choice(NASTY + [None])) for c in range(20) for t in range(r.randrange(1, 9))]
    rows += [(99, i, "assistant" if i % 2 else "user", f"{i} " + "w" * 40) for i in range(400)] + [(None, 1, "user", "x"), (None, None, "assistant", "y"), (5, 0, "user", "same"), (5, 0, "user", "same"), (98, 0, "assistant", "x" * 300_000)]
    df = spark.createDataFrame([(*x, 1, "c") for x in rows], "conv_id long, turn long, role string, text string, start int, formatted string").repartition(4)
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(df)).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append(((t is not None, t or 0), role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        g = got[c]
        assert (g.n_turns, g.turns_sha256) == (len(turns), digest("".join(f"{r}\n{t}\n" for _, r, t in turns)))
        assert (g.loss_chars, g.loss_sha256, g.formatted_chars) == (len(loss), digest(loss), len(chat.marked_turns([x[1:] for x in turns])))
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


def test_templates_not_declared_context_free_get_whole_prefixes(spark):
    turns = [("tool" if i == 190 else "user", f"turn {i}") for i in range(300)]
    quoting = lambda t: "".join(f"{t[0][1] if r == 'tool' else ''}{x}\n" for r, x in t)
    numbered = lambda t: "".join(f"{i} {x}\n" for i, (_, x) in enumerate(t))
    truncating = lambda t: chat.marked_turns(t[-200:])
    df = spark.createDataFrame([(1, i, r, x) for i, (r, x) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    for template in (quoting, numbered):
        assert chat.format_turns(turns, template, context_free=False)[0] == template(turns)
        assert "".join(r.formatted for r in chat.format_conversations(df, template).orderBy("turn_index").collect()) == template(turns)
    with pytest.raises(chat.RewritesHistory):
        chat.format_turns(turns, truncating, context_free=False)
    with pytest.raises(Exception, match="RewritesHistory"):
        chat.format_conversations(df, truncating).collect()
