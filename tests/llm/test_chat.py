"""The template compiler and formatted conversations read back."""

import hashlib
import random

import pytest

from lagweave.llm import chat

HARD = "</s>[INST] ok [/INST]"


def rendered(source, messages=()):
    pieces = [p for p in chat.compile_template(source)(iter(messages)) if p[1] is not None]
    return "".join(t for t, _ in pieces), "".join(t for t, g in pieces if g)


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("a{{ 'b' ~ 1 }}", "ab1"),
        ("{{ 1 + 2 }}", "3"),
        ("{% if 1 < 2 and not false %}y{% else %}n{% endif %}", "y"),
        ("{% if 'x' in 'abc' %}1{% elif 'a' in 'abc' %}2{% endif %}", "2"),
        ("{{ '  Ab ' | trim | upper }}", "AB"),
        ("{% set x = 'v' %}{{ x }}{{ missing }}", "v"),
        ("{{ '[INST]\\\\' | escape }}", "\\[INST]\\\\"),
    ],
)
def test_expressions(source, expected):
    assert rendered(source)[0] == expected


def test_constants_are_folded():
    tree = chat.fold(chat.parse("a{{ 'b' | upper }}{% if 1 == 2 %}no{% else %}c{{ 'd' ~ 1 }}{% endif %}e"))
    assert tree == (chat.Text("aBcd1e"),)
    assert chat.fold(chat.parse("{% if x and false %}n{% endif %}{% if true or x %}y{% endif %}"))[-1] == chat.Text("y")


@pytest.mark.parametrize(
    "source",
    ["{{ x() }}", "{{ x | nothing }}", "{% for m in range %}{% endfor %}", "{% if x %}", "{% import os %}", "{{ 'a' + 1 }}", "{{ x[0] }}", "{{ ((( }}", "{{" + "(" * 80 + "1" + ")" * 80 + "}}"],
)
def test_the_sandbox_refuses(source):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(source)


def test_fields_reach_messages_only():
    assert rendered("{{ messages.__class__ }}{% for m in messages %}{{ m.__class__ }}{{ m.role.x }}{{ loop.index }}{% endfor %}", [{"role": "r"}])[0] == "1"


def test_a_template_streams():
    def endless():
        for k in range(10**9):
            yield {"role": "user", "text": str(k)}

    pieces = chat.compile_template(chat.TEMPLATE)(endless())
    assert [next(pieces)[0] for _ in range(4)][-1] == "0"


def random_text(rng):
    return "".join(rng.choice([*chat.CONTROL, "\\", "<", "[", "s>", "/", "INST]", "é", "\n", "word ", "😀"]) for _ in range(rng.randrange(12)))


def test_escaping_is_reversible():
    rng = random.Random(4)
    for _ in range(3000):
        role, text = random_text(rng), random_text(rng)
        assert chat.unescape(chat.escape(text)) == text
        out, learned = rendered(chat.TEMPLATE, [{"role": role, "text": text}, {"role": "assistant", "text": text}])
        assert list(chat.turns_of(out)) == [(role, text), ("assistant", text)]
        assert chat.unescape(learned) == text * (2 if role == "assistant" else 1)


@pytest.mark.parametrize("part", [1, 500, chat.PART])
def test_conversations_read_back(spark, part):
    rng = random.Random(part)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "x\n"]), random_text(rng) if rng.random() > 0.05 else None) for c in range(40) for t in range(rng.randrange(1, 9))]
    rows += [(50, t, "assistant" if t % 2 else "user", "hot " * 20) for t in range(2000)]  # one conversation of a third of the rows and more
    rows += [(51, 1, "user", "twice"), (51, 1, "user", "twice"), (51, None, "system", "first"), (None, 0, "user", "no id"), (52, 0, "assistant", "long " * 50_000)]
    rng.shuffle(rows)
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn int, role string, text string, formatted string").repartition(5)
    got = {r["conv_id"]: tuple(r)[1:] for r in chat.read_chats(chat.format_chats(table, part=part)).collect()}
    conversations = {}
    for c, t, role, text in rows:
        conversations.setdefault(c, []).append((t is not None, t or 0, role is not None, role or "", text is not None, text or ""))
    assert set(got) == set(conversations)
    for c, own in conversations.items():
        turns = [(x[3], x[5]) for x in sorted(own)]
        loss = "".join(t for r, t in turns if r == "assistant")
        whole = rendered(chat.TEMPLATE, [{"role": r, "text": t} for r, t in turns])[0]
        expected = (
            len(turns),
            hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
            len(loss),
            hashlib.sha256(loss.encode()).hexdigest(),
            len(whole),
        )
        assert got[c] == expected


def test_the_query_adds_the_hard_conversation(spark):
    table = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    (row,) = chat.format_and_read(table).collect()
    assert row["conv_id"] == -1 and row["n_turns"] == 2 and row["loss_chars"] == len(HARD)
    assert row["loss_sha256"] == hashlib.sha256(HARD.encode()).hexdigest()
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{HARD}\nassistant\n{HARD}\n".encode()).hexdigest()
