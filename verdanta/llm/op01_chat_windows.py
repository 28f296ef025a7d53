"""Chat formatting in budgeted windows, with DataFrame functions only.

A conversation's turns are counted in tokens, and prefix sums of these counts choose windows whose new turns
start and end with a turn. A window is the system turn (if the conversation starts with one), then as many
whole turns just before its span as fit ``history`` tokens, then its span. The loss mask covers the
assistant's texts of the span alone: a turn repeated as history is masked, so each assistant text is a target
once. A turn too long for the budget makes a window of its own and stays whole.

Template: each turn is ``[INST]role`` newline, text, ``[/INST]`` newline, and a window stands between ``<s>``
and ``</s>``. Texts and roles have ``~`` written as ``~0``, ``[`` as ``~1`` and ``<`` as ``~2`` (in roles a
newline as ``~3``), so no control string can occur inside a text, and ``unescaped`` brings the text back.
A token here is a run of at most ``RUN`` characters that aren't white space, plus four for a turn's markers: a
stable count that Spark makes without a tokenizer, and which long runs without spaces can't escape.

Where a turn's history begins is the first turn in a range frame over the prefix sums; each window takes its own
turns out of the conversation before windows become rows. So work and memory are in proportion to the turns.

Cases: a null text or role is empty; turns with equal numbers are ordered by role, then text; repeated rows
are turns of their own, also when they repeat a whole conversation; rows with a null conv_id are one
conversation. A system row after the first turn is an ordinary turn. Extra columns are ignored. An empty table gives no windows.
A conversation becomes one row, since its turns are hashed in order as one text.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET, HISTORY = 512, 128
MARKER_TOKENS, RUN = 4, 8
STRETCH = 256
OPEN, CLOSE, START, END = "[INST]", "[/INST]\n", "<s>", "</s>"
ESCAPES = (("~", "~0"), ("[", "~1"), ("<", "~2"))


def escaped(text: Column, role: bool = False) -> Column:
    for plain, code in (*ESCAPES, *((("\n", "~3"),) if role else ())):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in (("\n", "~3"), *reversed(ESCAPES)):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def token_count(text: Column) -> Column:
    return (F.regexp_count(text, F.lit(rf"\S{{1,{RUN}}}")) + MARKER_TOKENS).cast("long")


def window_starts(ends: Column, budget: Column) -> Column:
    """Indices of the turns that start a span, from the turns' prefix sums (``ends``, 0 first).

    A span goes on while the tokens since its start stay within ``budget``; the fold keeps only the starts, in
    stretches of ``STRETCH``, since each one that is added copies its stretch.
    """
    n = F.size(ends) - 1
    state_of = lambda done, now, at: F.struct(done.cast("array<array<int>>").alias("done"), now.cast("array<int>").alias("now"), at.cast("int").alias("at"))

    def step(state: Column, i: Column) -> Column:
        fresh = (F.get(ends, i + 1) - F.get(ends, state["at"]) > budget) & (i > state["at"])
        full = F.size(state["now"]) == STRETCH
        return F.when(fresh & full, state_of(F.array_append(state["done"], state["now"]), F.array(i), i)).when(fresh, state_of(state["done"], F.array_append(state["now"], i), i)).otherwise(state)

    starts = F.aggregate(F.sequence(F.lit(0), n - 1), state_of(F.array(), F.array(F.lit(0)), F.lit(0)), step, lambda s: F.concat(F.flatten(s["done"]), s["now"]))
    return F.when(n > 0, starts).otherwise(F.array().cast("array<int>"))


def format_conversations(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Windows of every conversation: conv_id, window, formatted, n_repeated (leading turns that repeat others'), loss_spans.

    ``loss_spans`` are (start, length) in code points of ``formatted``, counted from 0.
    """
    if not 0 <= history < budget:
        raise ValueError("history must be at least 0 and below the budget")
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    upto = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("tokens", token_count(F.col("text")))
    rows = rows.withColumn("end", F.sum("tokens").over(upto)).withColumn("nr", F.count(F.lit(1)).over(upto).cast("int")).withColumn("begin", F.col("end") - F.col("tokens"))
    # the first turn whose tokens up to this one fit the history
    rows = rows.withColumn("back", F.min("nr").over(Window.partitionBy("conv_id").orderBy("begin").rangeBetween(-history, Window.currentRow)))
    body = F.concat(escaped(F.col("role"), role=True), F.lit("\n"), escaped(F.col("text")))
    turn = F.struct("nr", "end", "back", (F.col("role") == "assistant").alias("target"), (F.col("role") == "system").alias("system"), F.concat(F.lit(OPEN), body, F.lit(CLOSE)).alias("block"), F.char_length(escaped(F.col("role"), role=True)).alias("role_chars"))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    convs = convs.select("conv_id", "turns", F.concat(F.array(F.lit(0).cast("long")), F.transform("turns", lambda t: t["end"])).alias("ends"), F.get("turns", F.lit(0))["system"].cast("int").alias("sys"))
    room = F.lit(budget) - F.col("sys") * F.get("ends", F.lit(1)) - F.lit(history)
    convs = convs.withColumn("starts", window_starts(F.col("ends"), F.greatest(room, F.lit(1)))).drop("ends")

    def window(lo: Column, nth: Column) -> Column:
        since = F.greatest(F.get("turns", lo)["back"] - 1, F.least("sys", lo))
        lead = F.slice("turns", 1, F.when((F.col("sys") == 1) & (lo > 0), 1).otherwise(0))
        end = F.coalesce(F.get("starts", nth + 1), F.size("turns"))
        return F.struct(nth.alias("window"), F.concat(lead, F.slice("turns", since + 1, lo - since)).alias("repeated"), F.slice("turns", lo + 1, end - lo).alias("span"))

    spans = convs.select("conv_id", F.inline(F.transform("starts", window)))
    spans = spans.withColumn("all", F.concat("repeated", "span")).withColumn("n_repeated", F.size("repeated"))

    text = F.concat(F.lit(START), F.array_join(F.transform("all", lambda t: t["block"]), ""), F.lit(END))
    spans = spans.select("conv_id", "window", "n_repeated", "all", text.alias("formatted"), F.transform("all", lambda t: F.char_length(t["block"])).alias("sizes"))

    def step(state: Column, i: Column) -> Column:
        t = F.get("all", i)
        head = len(OPEN) + t["role_chars"] + 1
        span = F.struct((state["at"] + head).cast("int").alias("start"), (F.get("sizes", i) - head - len(CLOSE)).cast("int").alias("length"))
        wanted = t["target"] & (i >= F.col("n_repeated"))
        return F.struct((state["at"] + F.get("sizes", i)).cast("int").alias("at"), F.when(wanted, F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    zero = F.struct(F.lit(len(START)).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    loss = F.aggregate(F.sequence(F.lit(0), F.size("all") - 1), zero, step, lambda s: s["spans"])
    return spans.select("conv_id", "window", "formatted", "n_repeated", loss.alias("loss_spans"))


def read_back(windows: DataFrame) -> DataFrame:
    """Per window what its text says: new_turns (role, text) without the repeated ones, and the texts under the loss mask."""
    inner = F.expr(f"substring(formatted, {len(START) + 1}, char_length(formatted) - {len(START) + len(END)})")
    blocks = F.filter(F.split(inner, r"\[INST\]"), lambda b: b != "")
    bodies = F.transform(blocks, lambda b: F.substring(b, F.lit(1), F.char_length(b) - len(CLOSE)))
    new = F.slice(bodies, F.col("n_repeated") + 1, F.greatest(F.size(bodies) - F.col("n_repeated"), F.lit(0)))

    def parsed(body: Column) -> Column:
        cut = F.instr(body, "\n")
        return F.struct(unescaped(F.substring(body, F.lit(1), cut - 1)).alias("role"), unescaped(F.substring(body, cut + 1, F.char_length(body))).alias("text"))

    masked = F.transform("loss_spans", lambda s: unescaped(F.substring("formatted", s["start"] + 1, s["length"])))
    return windows.select("conv_id", "window", F.transform(new, parsed).alias("new_turns"), masked.alias("targets"), F.char_length("formatted").alias("formatted_chars"))


def conversation_digests(windows: DataFrame) -> DataFrame:
    """Per conversation: n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, all from the windows' texts."""
    per = read_back(windows).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "new_turns", "targets"))).alias("ws"), F.sum("formatted_chars").cast("long").alias("formatted_chars"))
    turns = F.flatten(F.transform("ws", lambda w: w["new_turns"]))
    told = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.flatten(F.transform("ws", lambda w: w["targets"])), "")
    return per.select("conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(F.encode(told, "UTF-8"), 256).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(F.encode(loss, "UTF-8"), 256).alias("loss_sha256"), "formatted_chars")
