"""Black-box rendering of long conversations, strict templates and refusals."""

import pytest

from lakewright.llm import chat_format as cf

LONG = [("user" if i % 2 == 0 else "assistant", f"turn {i} probe") for i in range(150)]


def strict(turns):
    """Append-only; insists on alternating roles that begin with the user."""
    for i, (role, _) in enumerate(turns):
        if role != ("user", "assistant")[i % 2]:
            raise ValueError("roles must alternate")
    return "".join(f"<{r}>{t}</{r}>" for r, t in turns)


def with_default_system(turns):
    return ("" if turns and turns[0][0] == "system" else "[be kind]") + "".join(f"<{r}>{t}" for r, t in turns)


def numbered(turns):
    return "".join(f"{i}:{r}:{t};" for i, (r, t) in enumerate(turns))


def pairs_only(turns):
    """Renders whole exchanges only."""
    if len(turns) % 2:
        raise ValueError("an answer is missing")
    return "".join(f"<{r}>{t}" for r, t in turns)


def last_shouts(turns):
    return "".join(f"<{t.upper() if i + 1 == len(turns) else t}>" for i, (_, t) in enumerate(turns))


@pytest.mark.parametrize("template", [cf.chat_template, strict, with_default_system, numbered, pairs_only])
def test_long_conversations_of_append_only_templates(template):
    whole, spans, rewrites = cf.located(template, LONG)
    assert whole == template(LONG) and rewrites is False
    assert [whole[a:b] for _, a, b, _ in spans] == [t for _, t in LONG]
    assert [s[0] for s in spans[1:]] == [s[3] for s in spans[:-1]] and spans[-1][3] == len(whole)


def test_rewriting_and_refusing_templates():
    whole, spans, rewrites = cf.located(last_shouts, [("user", "a"), ("assistant", "bc")])
    assert rewrites is True and len(spans) == 2
    assert cf.located(strict, [("assistant", "x")]) == (None, [], None)


def test_refusals_and_the_trap_in_the_table(spark):
    rows = [(1, 0, "assistant", "x"), (2, 0, "user", "x"), (2, 1, "assistant", "y"), (-1, 0, "user", "mine")]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")

    def strict(turns):
        if turns and turns[0][0] != "user":
            raise ValueError("the user speaks first")
        return "".join(f"<{r}>{t}</{r}>" for r, t in turns)

    got = {r.conv_id: r for r in cf.formatted(chats, strict).collect()}
    assert got[1].formatted is None and got[1].rewrites is None and got[1].loss == [] and got[2].formatted == "<user>x</user><assistant>y</assistant>"
    back = {r.conv_id: r for r in cf.read_back(cf.formatted(chats, strict)).collect()}
    assert back[1].n_turns == 0 and back[1].formatted_chars == 0
    trapped = cf.read_back(cf.formatted(cf.with_trap(chats), keys=("planted",))).where("conv_id = -1").collect()
    assert sorted(r.n_turns for r in trapped) == [1, 2]
