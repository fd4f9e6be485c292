"""Chat formatting: round trips, templates that rewrite history, blocks, edge rows."""

import hashlib
import random
import sys

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle

from postkit.llm import chat_format as cf

cloudpickle.register_pickle_by_value(sys.modules[__name__])      # workers need no copy of the tests

CONV = "conv_id long, turn long, role string, text string, block long, pos string, total string, formatted string"
PIECES = ["<s>", "</s>", "[INST]", "[/INST]", "[TURN]", "[/TURN]", "[ROLE]", "\\", " ", "a", "é", "<", "[", "\n"]
texts = st.lists(st.sampled_from(PIECES), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(texts)
def test_escape_is_reversible_and_leaves_no_bare_mark(text):
    assert cf.unescape(cf.escape(text)) == text
    assert " [/INST]" not in cf.escape(text) and " </s>" not in cf.escape(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "[ROLE] </s>"]), texts), max_size=6))
def test_output_reads_back(turns):
    out, spans = cf.locate(cf.instruct, turns, ("assistant",))
    assert list(cf.read_back(out)) == turns
    assert [out[s.start:s.end] for s in spans] == [cf.instruct([t]) for t in turns]
    assert [cf.unescape(out[s.text_start:s.text_end]) for s in spans if s.role == "assistant"] == [t for r, t in turns if r == "assistant"]
    assert not any(s.rewritten for s in spans)


def table(spark, rows):
    return spark.createDataFrame([(c, t, r, x, 1, "p", "t", "f") for c, t, r, x in rows], CONV)


def expected(rows):
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted((t is not None, t or 0, r or "", x or "") for k, t, r, x in rows if k == c)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in turns).encode()).hexdigest(), len(loss),
                  hashlib.sha256(loss.encode()).hexdigest(), len(cf.instruct([(r, x) for _, _, r, x in turns])), 0, True)
    return out


@pytest.mark.parametrize("block,context", [(32, 1), (2, 1), (4, 2), (None, 1)])
def test_conversations_of_any_length(spark, block, context):
    r = random.Random(7)
    text = lambda: "".join(r.choice(PIECES) for _ in range(r.randint(0, 9)))
    rows = [(c, t, r.choice(["user", "assistant", "assistant", "tool"]), text()) for c in range(30) for t in range(r.randint(1, 9))]
    rows += [(99, t, "user" if t % 2 == 0 else "assistant", text()) for t in range(700)]                    # a hot conversation
    rows += [(None, 0, "user", "x"), (None, None, None, None), (5, None, "assistant", None), (6, 0, None, "[INST]"), (7, 0, "assistant", ""),
             (8, 1, "assistant", "same"), (8, 1, "assistant", "same"), (50, 0, "user", "y" * 100_000), (50, 1, "assistant", "</s>" * 30_000)]
    r.shuffle(rows)
    blocks = cf.format_conversations(table(spark, rows), block=block, context=context)
    got = {x[0]: tuple(x)[1:] for x in cf.digests(blocks).collect()}
    assert got == expected(rows)
    found = sorted((x for x in blocks.collect() if x.conv_id == 99), key=lambda x: x.block)
    turns = [(role, text) for _, _, role, text in sorted(x for x in rows if x[0] == 99)]
    assert "".join(x.formatted for x in found) == cf.instruct(turns)
    assert [x.formatted[s.start:s.end] for x in found for s in x.spans] == [cf.instruct([t]) for t in turns]
    assert len(found) == (1 if block is None else -(-700 // block))


def test_empty_table_and_types(spark):
    empty = cf.format_conversations(table(spark, [(1, 0, "user", "x")]).where("false"))
    assert cf.digests(empty).collect() == []
    named = spark.createDataFrame([("a", 1, "assistant", "hi")], "conv_id string, turn int, role string, text string")
    assert cf.digests(cf.format_conversations(named)).first()[:2] == ("a", 1)


def closing(turns):
    return "".join(f"[{r}] {t}\n" for r, t in turns) + "<end>"


def numbered(turns):
    return "".join(f"{i} {r}: {t}\n" for i, (r, t) in enumerate(turns))


def trimmed(turns):
    return "".join(f"{r}: {t.strip()}\n" for r, t in turns)


def reading(turns):
    """Drops what the assistant thought in all turns but the last, as some templates do."""
    return "".join(f"{r}: {t if i == len(turns) - 1 else t.split('#')[-1]}\n" for i, (r, t) in enumerate(turns))


def pieces(text):
    return []


@pytest.mark.parametrize("template,block,rewritten,whole", [
    (closing, None, 5, False), (reading, None, 2, False), (trimmed, None, 0, False), (numbered, None, 0, True), (numbered, 2, 0, False)])
def test_other_templates_are_seen_through(spark, template, block, rewritten, whole):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f" think {t}# say {t}") for t in range(6)]
    if template is reading:
        rows = [(c, t, r, x if r == "assistant" else "q") for c, t, r, x in rows]
    (row,) = cf.digests(cf.format_conversations(table(spark, rows), template, block=block, plain=str), read=pieces, plain=str).collect()
    assert (row.rewritten, row.whole) == (rewritten, whole)
