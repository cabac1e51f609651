"""Chat formatting into budgeted windows.

Prefix sums of turn tokens cut a conversation into turn-aligned spans: turns whose prefix
falls into the same stride share a span, and a turn longer than the stride is a span of
its own. A window is the system turn (kept in every window), the turns at the end of the
previous span that fit the history budget, and the span itself. Repeated turns carry no
loss, so each assistant text is a target exactly once.

A turn is written as <|im_start|>role, a line break, the text, <|im_end|> and a line break. In roles and
texts a backslash becomes two and "<|" becomes "<\\|"; a line break in a role becomes "\\n".
Both are undone by `read_back`.

Rows are ordered by (turn, role, text), null turns first. Null texts and roles are empty;
conversations without rows do not exist; a null conversation id is a conversation;
repeated rows are turns of their own; other columns are ignored. A conversation with a
large share of all rows is numbered in buckets of turn ranges, never sorted in one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

BUDGET, HISTORY = 2048, 256
BUCKET = 256
ROLE_ASSISTANT, ROLE_SYSTEM = "assistant", "system"
TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)
ESCAPE = re.compile(r"\\(.)", re.S)


def escaped(text: Column) -> Column:
    """Text without control strings; reversible."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: str) -> str:
    return ESCAPE.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def turn_tokens(tokenizer: str):
    """A vectorised token counter over a ranks file of a public byte-level vocabulary."""

    @F.pandas_udf(T.LongType())
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import base64

        import public_tokenizers
        import tiktoken

        with open(tokenizer, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        coding = tiktoken.Encoding("turns", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in texts:
            yield batch.map(lambda t: len(coding.encode_ordinary(t)))

    return count


def windows(conversations: DataFrame, count_tokens, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Windows of every conversation.

    Returns conv_id, window (from 0), text, loss_spans (start and end code points in `text` of the
    escaped target texts), repeated (leading turns that repeat earlier ones), tokens. A
    window holds at most `budget` tokens of new turns and history unless one turn is longer;
    the system turn comes on top.
    """
    if not 0 <= history < budget:
        raise ValueError("history must be shorter than the budget")
    stride = max((budget - history) // 2, 1)
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumns({
        "_bucket": F.floor(F.col("turn") / BUCKET),
        "_role": F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\n")),
        "_text": escaped(F.col("text")),
    })
    rows = rows.withColumn(
        "_tokens", count_tokens(F.concat(F.lit("<|im_start|>"), "_role", F.lit("\n"), "_text", F.lit("<|im_end|>\n")))
    )
    turns = _prefix_sums(rows, stride)
    return _windows(turns, history)


def _prefix_sums(rows: DataFrame, stride: int) -> DataFrame:
    """Number the turns and their spans; only bucket totals meet in one task per conversation."""
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    local = W.partitionBy("conv_id", "_bucket").orderBy(*order)
    running = local.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({"_no": F.row_number().over(local), "_sum": F.sum("_tokens").over(running)})
    totals = rows.groupBy("conv_id", "_bucket").agg(F.count(F.lit(1)).alias("_n"), F.sum("_tokens").alias("_t"))
    before = W.partitionBy("conv_id").orderBy(F.col("_bucket").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(
        F.col("conv_id").alias("_c"), F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_t0"),
    )
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("_bucket").eqNullSafe(F.col("_b"))
    rows = rows.join(totals, same).drop("_c", "_b").withColumns({
        "no": F.col("_n0") + F.col("_no") - 1, "end": F.col("_t0") + F.col("_sum"),
    }).withColumn("start", F.col("end") - F.col("_tokens"))
    # A span is named by the stride it starts in and by the number of its first long turn:
    # long turns stand alone, so the name is (stride, own number if long).
    long_turn = F.col("_tokens") > stride
    long_ends = F.when(long_turn, F.col("end"))
    # the last long turn before this one separates spans as well; its end is at most this start
    last_long = F.max(long_ends).over(local.rowsBetween(W.unboundedPreceding, -1))
    carried = rows.groupBy("conv_id", "_bucket").agg(F.max(long_ends).alias("_l"))
    carried = carried.select(
        F.col("conv_id").alias("_c"), F.col("_bucket").alias("_b"), F.max("_l").over(before).alias("_l0")
    )
    rows = rows.withColumn("_last", last_long).join(carried, same).drop("_c", "_b")
    return rows.select(
        "conv_id", "no", "role", "_role", "_text", "_tokens", "start", "end",
        F.struct(
            F.greatest(F.coalesce("_last", "_l0", F.lit(-1)), F.coalesce("_l0", F.lit(-1))).alias("after_long"),
            F.when(long_turn, F.lit(1)).otherwise(0).alias("alone"),
            F.when(long_turn, F.col("start")).otherwise(F.floor(F.col("start") / stride)).alias("stride"),
        ).alias("_span"),
    )


def _windows(turns: DataFrame, history: int) -> DataFrame:
    spans = turns.groupBy("conv_id", "_span").agg(F.min("no").alias("_first"), F.max("end").alias("_end"), F.min("start").alias("_start"))
    # spans are few per conversation compared with turns; they are numbered by their first turn
    by_conv = W.partitionBy("conv_id").orderBy("_first")
    spans = spans.withColumns({
        "window": F.row_number().over(by_conv) - 1, "_more": F.lead("_first").over(by_conv).isNotNull(),
    })
    right = spans.select(F.col("conv_id").alias("_c"), F.col("_span").alias("_s"), "window", "_end", "_more")
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_span") == F.col("_s"))
    placed = turns.join(right, same).drop("_c", "_s")
    # the first turn, if it is a system turn, goes to every window
    system = placed.filter((F.col("no") == 0) & (F.col("role") == ROLE_SYSTEM)).select(
        F.col("conv_id").alias("_c"), F.col("_role").alias("_sr"), F.col("_text").alias("_st"), F.col("_tokens").alias("_sk")
    )
    is_system = (F.col("no") == 0) & (F.col("role") == ROLE_SYSTEM)
    in_history = F.col("_more") & ~is_system & (F.col("_end") - F.col("start") <= history)
    own = F.struct("window", F.lit(False).alias("again"))
    again = F.struct((F.col("window") + 1).alias("window"), F.lit(True).alias("again"))
    spread = placed.withColumn("_at", F.explode(F.when(in_history, F.array(own, again)).otherwise(F.array(own))))
    part = F.struct(
        "no", F.col("_at.again").alias("again"), "_role", "_text", "_tokens",
        (F.col("role") == ROLE_ASSISTANT).alias("target"),
    )
    gathered = spread.groupBy("conv_id", F.col("_at.window").alias("window")).agg(F.sort_array(F.collect_list(part)).alias("_parts"))
    joined = gathered.join(system, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("window") > 0), "left")
    first = F.when(F.col("_st").isNotNull(), F.array(F.struct(
        F.lit(-1).cast("long").alias("no"), F.lit(True).alias("again"), F.col("_sr").alias("_role"),
        F.col("_st").alias("_text"), F.col("_sk").alias("_tokens"), F.lit(False).alias("target"),
    ))).otherwise(F.filter("_parts", lambda p: F.lit(False)))
    parts = joined.select("conv_id", "window", F.concat(first, "_parts").alias("_parts"))
    head = lambda p: F.concat(F.lit("<|im_start|>"), p["_role"], F.lit("\n"))
    tail = "<|im_end|>\n"
    sizes = F.transform("_parts", lambda p: F.length(head(p)) + F.length(p["_text"]) + len(tail))
    parts = parts.withColumn("_sizes", sizes)
    offset = lambda i: F.aggregate(F.slice("_sizes", 1, i), F.lit(0), lambda a, s: a + s)
    spans_of = F.transform("_parts", lambda p, i: F.struct(
        (offset(i) + F.length(head(p))).alias("start"), (offset(i) + F.length(head(p)) + F.length(p["_text"])).alias("end"),
        (p["target"] & ~p["again"]).alias("loss"),
    ))
    return parts.select(
        "conv_id", "window",
        F.concat_ws("", F.transform("_parts", lambda p: F.concat(head(p), p["_text"], F.lit(tail)))).alias("text"),
        F.transform(F.filter(spans_of, lambda s: s["loss"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("loss_spans"),
        F.size(F.filter("_parts", lambda p: p["again"])).alias("repeated"),
        F.aggregate("_parts", F.lit(0).cast("long"), lambda a, p: a + p["_tokens"]).alias("tokens"),
    )


def read_window(text: str, loss_spans, repeated: int) -> tuple[list[tuple[str, str]], list[str]]:
    """New turns (role, text) and target texts of one formatted window."""
    turns = [(unescaped(r), unescaped(t)) for r, t in TURN.findall(text)]
    return turns[repeated:], [unescaped(text[s["start"] : s["end"]]) for s in loss_spans]


READ_BACK = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, parsed from the formatted windows.

    The digests run over sorted windows as they stream through a task, so memory is one
    Arrow batch and two hash states, however long a conversation is.
    """
    import hashlib

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None
        done: list[tuple] = []

        def close():
            if state is not None:
                conv, n, turns, chars, loss, size = state
                done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))

        for batch in batches:
            for conv, text, spans, repeated in zip(batch["_key"], batch["text"], batch["loss_spans"], batch["repeated"], strict=True):
                if state is None or state[0] != conv:
                    close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turns, targets = read_window(text, spans, repeated)
                state[1] += len(turns)
                for role, said in turns:
                    state[2].update(f"{role}\n{said}\n".encode())
                for said in targets:
                    state[3] += len(said)
                    state[4].update(said.encode())
                state[5] += len(text)
            if len(done) > 1000:
                yield pd.DataFrame(done, columns=READ_BACK)
                done.clear()
        close()
        yield pd.DataFrame(done, columns=READ_BACK)

    keyed = formatted.withColumn("_key", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))
    ordered = keyed.repartition("_key").sortWithinPartitions("_key", "window").select("_key", "window", "text", "loss_spans", "repeated")
    out = ordered.mapInPandas(
        run, "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
    return out.withColumn("conv_id", F.when(F.col("conv_id") != "null", F.col("conv_id")).cast("long"))
