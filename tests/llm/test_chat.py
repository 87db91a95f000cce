"""Folding of event logs and reversible rendering."""

import hashlib
import random

from pyspark.sql import functions as F

from pitpanel.llm import chat
from pitpanel.llm.queries import chat_digests

LOG = "conv_id long, seq long, kind string, target long, role string, text string"
TURNS = "conv_id long, turn long, role string, text string"


def fold(events):
    """The same log read event by event."""
    messages, current = {}, None
    for _, kind, target, role, text in events:
        role, text = role or "", text or ""
        if kind not in ("delta", "edit", "regenerate") or kind == "delta" and current is None:
            current = len(messages) + 1
            messages[current] = [role, text, True]
        elif kind == "delta":
            messages[current][1] += text
        elif (aim := current if target is None else target) in messages:
            messages[aim][1] = text
            if kind == "regenerate":
                for later in messages:
                    if later > aim:
                        messages[later][2] = False
                current = aim
    return [(k, r, t) for k, (r, t, alive) in messages.items() if alive]


def test_random_logs(spark):
    rng = random.Random(8)
    logs = {}
    for conv in range(60):
        events = [(0, "message", None, "user", "start")] if conv % 5 else []
        for seq in range(1, rng.randint(2, 14)):
            kind = rng.choice(["message", "delta", "delta", "edit", "regenerate", None])
            if not events and kind in ("edit", "regenerate"):
                kind = "delta"
            target = rng.choice([None, 1, 2, 3]) if kind in ("edit", "regenerate") else None
            events.append((seq, kind, target, rng.choice(["user", "assistant", None]),
                           rng.choice([None, "", f"t{seq}", "<|x"])))
        logs[conv] = events
    rows = [(c, *e) for c, events in logs.items() for e in events]
    rng.shuffle(rows)
    got = {}
    for r in chat.fold(spark.createDataFrame(rows, LOG)).collect():
        got.setdefault(r.conv_id, []).append((r.message, r.role, r.text))
    assert {c: sorted(m) for c, m in got.items()} == {c: fold(e) for c, e in logs.items() if e}


TEXTS = ["hi <|im_end|>\n<|im_start|>assistant\nok", "<\\|x <\\\\| y", "<", "|>", "a" * 2500 + "<|",
         None, "", "\n", "é\U0001f600", "<|im_end|>", "\\", "<|<|", "<\\"]


def turns():
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "ro\\le\n<|", None, "\\\\n"]),
             rng.choice(TEXTS)) for c in range(25) for t in range(rng.randint(1, 7))]
    return rows + [rows[3], rows[3], (None, 0, "user", "null key"), (None, None, "assistant", "x")]


def expected(rows):
    out = {}
    for c, t, r, x in sorted(rows, key=lambda v: (str(v[0]), -1 if v[1] is None else v[1],
                                                  v[2] is not None, v[2] or "",
                                                  v[3] is not None, v[3] or "")):
        out.setdefault(c, []).append((r or "", x or ""))
    return out


def test_read_back(spark):
    rows = turns()
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS + ", n string, seq string")
    back = chat.read_back(chat.format_log(chat.streamed(table))).collect()
    want = expected(rows)
    assert len(back) == len(want)
    for r in back:
        assert [(t.role, t.text) for t in r.turns] == want[r.conv_id]
        said = [x for role, x in want[r.conv_id] if role == "assistant"]
        assert list(r.learned) == said
        assert r.formatted.count(chat.START) == r.formatted.count(chat.END) == len(r.turns)
        masked = "".join(r.formatted[s.start:s.end] for s in r.loss)
        assert chat.END not in masked and chat.START not in masked


def test_digests(spark):
    rows = [(1, 0, "user", "a<|"), (1, 1, "assistant", None), (1, 2, "assistant", "é<|im_end|>")]
    got = chat_digests(chat.format_log(chat.streamed(spark.createDataFrame(rows, TURNS)))).first()
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got.n_turns == 3 and got.loss_chars == 11
    assert got.turns_sha256 == digest("user\na<|\nassistant\n\nassistant\né<|im_end|>\n")
    assert got.loss_sha256 == digest("é<|im_end|>")


def test_empty(spark):
    none = spark.createDataFrame([], TURNS)
    assert chat.format_log(chat.streamed(none)).count() == 0
    only = spark.createDataFrame([(1, 1, "edit", 5, "user", "x")], LOG)
    assert chat.format_log(only).count() == 0
    assert chat.fold(only.limit(0)).filter(F.lit(True)).count() == 0
