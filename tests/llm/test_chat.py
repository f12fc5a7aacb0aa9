import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from millpond.llm import chat

LOG = "conv_id long, seq long, message long, role string, kind string, text string"
ODD = ["<s>", "</s>", "[INST]", "[/INST]", "[\\INST]", "<<SYS>>", "<</SYS>>", "<", "[", "\\", "\n", "a", "é🙂", "[ROLE]", "[/ROLE]", "[/TURN]", "[\\\\/TURN]", "$1", ""]


def plain_fold(events):
    """Final messages of each conversation, event by event."""
    done = defaultdict(dict)
    for conv, _, message, role, kind, text in sorted(events, key=lambda e: (e[0], e[1])):
        held = done[conv]
        if kind == "regenerate":
            for later in [m for m in held if m > message]:
                del held[later]
        before = held.get(message, (None, ""))[1]
        held[message] = (role, before + text if kind == "delta" else text)
    return {(c, m, *v) for c, held in done.items() for m, v in held.items()}


def test_folding_equals_a_plain_version(spark):
    r = random.Random(5)
    for _ in range(3):
        events = []
        for conv in range(40):
            for seq in range(r.randint(1, 30)):
                kind = r.choices(["message", "delta", "edit", "regenerate"], [2, 5, 2, 1])[0]
                events.append((conv if r.random() < 0.6 else 7, conv * 1000 + seq, r.randint(0, 4), r.choice(["user", "assistant"]), kind, r.choice(ODD)))
        found = {tuple(x) for x in chat.fold(spark.createDataFrame(events, LOG)).collect()}
        assert found == plain_fold(events)


def test_formatted_text_is_read_back(spark):
    r = random.Random(6)
    rows = [(c, t, r.choice(["user", "assistant", "system", "tool", "[/ROLE]<s>", ""]), "".join(r.choices(ODD, k=r.randint(0, 9)))) for c in range(200) for t in range(r.randint(1, 6))]
    done = chat.read_back(chat.render(spark.createDataFrame(rows, "conv_id long, message long, role string, text string"))).collect()
    want = defaultdict(list)
    for c, _, role, text in rows:
        want[c].append((role, text))
    assert {x.conv_id: [tuple(t) for t in x.turns] for x in done} == want
    for x in done:
        assert x.loss == "".join(t for role, t in want[x.conv_id] if role == "assistant")
        # Spans point into the formatted text, and behind each the turn ends.
        assert [x.formatted[s.start - 3 : s.start] + x.formatted[s.end : s.end + 4] for s in x.spans] == ["<s></s>"] * len(x.spans)
        assert all(x.formatted[s.at : s.start] == "<s>" for s in x.spans)


def digests(rows):
    held = defaultdict(list)
    for c, t, role, text in [*rows, *((-1, i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(["user", "assistant"]))]:
        held[c].append((t is not None, t, role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = set()
    for c, turns in held.items():
        turns.sort()
        loss = "".join(x for *_, role, x in turns if role == "assistant")
        out.add((c, len(turns), sha("".join(f"{role}\n{x}\n" for *_, role, x in turns)), len(loss), sha(loss)))
    return out


def test_odd_rows(spark):
    rows = [
        (1, 0, "user", None), (1, 1, "assistant", "a\nb\n"), (1, 1, "assistant", "a\nb\n"), (1, 1, "user", "tie"), (None, 0, "assistant", "x"), (None, 1, "assistant", ""),
        (2, None, "assistant", "\n"), (2, 3, None, "[/TURN]"), (3, 0, "assistant", "word </s> " * 40_000), (4, 0, "user", ""),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    clash = df.withColumns({c: F.lit("x") for c in ["message", "seq", "log", "kind", "formatted", "spans", "turns", "_pieces", "at", "piece"]})
    for given in (df, clash):
        assert {tuple(x)[:5] for x in chat.report(given).collect()} == digests(rows)
    assert {tuple(x)[:5] for x in chat.report(df.limit(0)).collect()} == digests([])
    empty = chat.format_chats(spark.createDataFrame([], LOG))
    assert empty.count() == 0 and empty.columns == ["conv_id", "formatted", "spans"]


def test_a_long_conversation_takes_time_in_proportion(spark):
    import time

    n = 30_000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("text [INST] "), F.col("id")).alias("text"))
    start = time.time()
    found = chat.report(rows).where("conv_id = 1").first()
    assert found.n_turns == n and time.time() - start < 60
    assert found.loss_chars == sum(len(f"text [INST] {i}") for i in range(1, n, 2))


def test_only_dataframe_functions(spark, small):
    df = spark.read.parquet(f"{small}/conversations.parquet")
    plan = chat.report(df)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
    # One shuffle of the table's texts, one of the fixed conversation's beside it at most.
    assert plan.count("Exchange hashpartitioning") <= 2, plan
