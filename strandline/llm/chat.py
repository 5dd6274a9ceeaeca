"""Chat formatting by prefix-target expansion.

Native: DataFrame functions only. Every turn becomes one segment of its
conversation's text; every assistant turn becomes an example of its own, whose
context is all of that text before it and whose trainable span is its reply.
The output (``output``) writes every example out, with its whole context, and
in a row of its own the turns of a conversation after its last example.
``read_examples`` reads everything back from these texts: an example counts
only if its context is the text of the example before it and its last turn is
the assistant's; its loss is cut at the mask that it states. Contexts overlap,
so the output grows with the square of a conversation's turns; texts are made
row by row from the conversation's, and what is read back from each is no more
than its own turns and digests of its context and text.

``written``, ``examples`` and ``read_back`` are a shorter form of the same
output, each conversation's text once and examples that point into it; the
query doesn't use it. ``rendered`` writes chosen examples of it out.

Template, for each turn: ``### ROLE: TEXT</turn>`` and a line feed. In texts
and roles these strings are replaced, so no text can forge a mark, and put
back in the opposite order on reading: backslash by ``\\b``, ``###`` by
``\\h``, ``</turn>`` by ``\\e``; in roles also the colon by ``\\c``. After the
first replacement each backslash is followed by b, h, e or c only, so the
steps can't mix.

Defined results: null texts and roles count as empty; rows are ordered by
turn, then role, then text, null turns first; repeated rows are separate
turns; only the role ``assistant`` is trained; a conversation without
assistant turns has no examples, and its loss is the empty text; null
conv_ids form one conversation; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the template.
HEAD, COLON, TAIL = "### ", ": ", "</turn>\n"
ESCAPES = [("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\e")]
ROLE_ESCAPES = [*ESCAPES, (":", "\\c")]
TRAINED = "assistant"


def escaped(text: Column, pairs=ESCAPES) -> Column:
    for plain, code in pairs:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column, pairs=ESCAPES) -> Column:
    for plain, code in reversed(pairs):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def segment(role: Column, text: Column) -> Column:
    return F.concat(F.lit(HEAD), escaped(role, ROLE_ESCAPES), F.lit(COLON), escaped(text), F.lit(TAIL))


def loss_start(seg: Column) -> Column:
    """Characters before the reply: head, role, colon and blank."""
    return F.length(F.substring_index(seg, ":", 1)) + len(COLON)


def role_of(seg: Column) -> Column:
    return unescaped(F.substr(F.substring_index(seg, ":", 1), F.lit(len(HEAD) + 1)), ROLE_ESCAPES)


def text_of(seg: Column) -> Column:
    at = loss_start(seg)
    return unescaped(F.substr(seg, at + 1, F.length(seg) - at - len(TAIL)))


def segments(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, segment for each row of conv_id, turn, role and text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text")).withColumn("segment", segment(F.col("role"), F.col("text")))


def expanded(segs: DataFrame) -> DataFrame:
    """Add example (from 0; null for turns that aren't trained), context_chars, loss_from, loss_chars to segments.

    The example's text is the first ``context_chars`` characters of the
    conversation's text and then ``segment``; the loss mask covers
    ``loss_chars`` characters from ``loss_from``, counted in the example.
    A window over one conversation is the largest unit of work; its rows spill.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    start = F.coalesce(F.sum(F.length("segment").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    trained = role_of(F.col("segment")) == TRAINED
    nth = F.sum(trained.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1
    at = loss_start(F.col("segment"))
    return segs.withColumns({"context_chars": start, "example": F.when(trained, nth)}).withColumns(
        {"loss_from": F.when(trained, F.col("context_chars") + at), "loss_chars": F.when(trained, (F.length("segment") - at - len(TAIL)).cast("long"))}
    )


def examples(segs: DataFrame) -> DataFrame:
    """One row for each assistant turn, with all turns before it as context and only its reply trainable."""
    return expanded(segs).filter(F.col("example").isNotNull()).drop("role", "text")


def rendered(segs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Write the examples of ``chosen`` out: conv_id, example, text, loss_from, loss_chars.

    Its size is the sum of all contexts, which for a long conversation grows
    with the square of its turns; choose accordingly.
    """
    whole = written(segs).withColumnRenamed("text", "whole")
    same = whole.conv_id.eqNullSafe(chosen.conv_id)
    text = F.concat(F.substr("whole", F.lit(1), F.col("context_chars").cast("int")), "segment")
    return chosen.join(whole, same).select(chosen.conv_id, "example", text.alias("text"), "loss_from", "loss_chars")


def output(segs: DataFrame) -> DataFrame:
    """conv_id, example, text, loss_from, loss_chars: every example with its context, and with a null example the turns after a conversation's last one.

    A row holds one example, made from the conversation's text as rows are read.
    """
    one = F.struct("turn", "role", "text", "segment", "example", "context_chars", "loss_from", "loss_chars")
    by = expanded(segs).groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("ts"))
    upto = lambda t: t.context_chars + F.length(t.segment)
    shown = F.transform(F.filter("ts", lambda t: t.example.isNotNull()), lambda t: F.struct(t.example.alias("example"), F.lit(0).cast("long").alias("at"), upto(t).alias("upto"), t.loss_from.alias("loss_from"), t.loss_chars.alias("loss_chars")))
    by = by.select("conv_id", F.array_join(F.transform("ts", lambda t: t.segment), "").alias("whole"), shown.alias("shown"), upto(F.element_at("ts", -1)).alias("size"))
    last = F.coalesce(F.get(F.col("shown.upto"), F.size("shown") - 1), F.lit(0).cast("long"))
    rest = F.struct(F.lit(None).cast("long").alias("example"), last.alias("at"), F.col("size").alias("upto"), F.lit(None).cast("long").alias("loss_from"), F.lit(None).cast("long").alias("loss_chars"))
    rows = by.select("conv_id", "whole", F.inline(F.concat("shown", F.when(F.col("size") > last, F.array(rest)).otherwise(F.slice(F.array(rest), 1, 0)))))
    return rows.select("conv_id", "example", F.substr("whole", (F.col("at") + 1).cast("int"), (F.col("upto") - F.col("at")).cast("int")).alias("text"), "loss_from", "loss_chars")


def read_examples(rows: DataFrame) -> DataFrame:
    """What rows of ``output`` say, by conversation, with the columns of ``read_back``.

    Every turn is taken from the example that it is new in: those after the
    last trained turn of its context. The digest of a context must be that of
    the text of the example before.
    """
    segs = F.transform(F.filter(F.split("text", TAIL), lambda b: b != ""), lambda b: F.concat(b, F.lit(TAIL)))
    each = rows.withColumn("segs", segs)
    before = F.transform(F.slice("segs", 1, F.greatest(F.size("segs") - 1, F.lit(0))), lambda s: s.startswith(f"{HEAD}{TRAINED}{COLON}"))
    back = F.array_position(F.reverse(before), True).cast("int")  # trained turns of the context, from its end
    each = each.withColumn("own", F.when(F.col("example").isNull() | (back == 0), F.col("segs")).otherwise(F.slice("segs", F.size("segs") - back + 1, back)))
    each = each.withColumn("context", F.expr("left(text, length(text) - length(array_join(own, '')))"))
    said = F.array_join(F.transform("own", lambda s: F.concat(role_of(s), F.lit("\n"), text_of(s), F.lit("\n"))), "")
    loss = unescaped(F.substr("text", (F.col("loss_from") + 1).cast("int"), F.col("loss_chars").cast("int")))
    ends = F.element_at("segs", -1).startswith(f"{HEAD}{TRAINED}{COLON}")
    facts = F.struct(
        F.col("example").isNull().alias("rest"), "example", F.size("own").cast("long").alias("turns"), said.alias("said"), loss.alias("loss"), ends.alias("trained"),
        F.length("text").cast("long").alias("chars"), F.sha2("context", 256).alias("context"), F.sha2("text", 256).alias("all"),
    )
    by = each.select("conv_id", facts.alias("e")).groupBy("conv_id").agg(F.array_sort(F.collect_list("e")).alias("es"))
    follows = lambda e, i: (e.example == i) & e.trained & (e.context == F.when(i == 0, F.sha2(F.lit(""), 256)).otherwise(F.get("es", i - 1)["all"]))
    right = F.filter("es", lambda e, i: F.coalesce(follows(e, i), F.lit(False)))
    total = lambda c: F.aggregate("es", F.lit(0).cast("long"), lambda a, e: a + e[c])
    by = by.select("conv_id", total("turns").alias("n_turns"), F.array_join(F.transform("es", lambda e: e.said), "").alias("said"), right.alias("right"), total("chars").alias("formatted_chars"))
    by = by.withColumns({"loss": F.array_join(F.transform("right", lambda e: e.loss), ""), "n_examples": F.size("right").cast("long")})
    return by.select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples")


def written(segs: DataFrame) -> DataFrame:
    """conv_id, text: every conversation's segments in order."""
    each = F.array_sort(F.collect_list(F.struct("turn", "role", "text", "segment")))
    return segs.groupBy("conv_id").agg(F.array_join(F.transform(each, lambda s: s.segment), "").alias("text"))


def turns_of(texts: DataFrame) -> DataFrame:
    """conv_id, nth, at, segment: the turns of written conversations, by the marks in their text; at counts the characters before a turn."""
    each = texts.select("conv_id", F.posexplode(F.split("text", TAIL)).alias("nth", "body")).filter("body <> ''").withColumn("segment", F.concat("body", F.lit(TAIL)))
    before = Window.partitionBy("conv_id").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    return each.select("conv_id", "nth", F.coalesce(F.sum(F.length("segment").cast("long")).over(before), F.lit(0)).alias("at"), "segment")


def read_back(texts: DataFrame, exs: DataFrame) -> DataFrame:
    """What the output says, by conversation: n_turns, digests of turns and loss, formatted_chars, n_examples.

    ``texts`` is from ``written``, ``exs`` from ``examples``. formatted_chars
    counts every example with its context, and the turns after the last one.
    A digest of a whole conversation needs its text in one place, so a
    conversation is the largest unit of work here.
    """
    turns = turns_of(texts)
    mine = exs.select(F.col("conv_id").alias("cid"), "example", "context_chars", "loss_from", "loss_chars", F.col("segment").alias("target"))
    # The context must be the text up to this turn, and the turn the example's own.
    same = F.col("conv_id").eqNullSafe(F.col("cid")) & (F.col("at") == F.col("context_chars")) & (F.col("segment") == F.col("target"))
    seg = F.col("segment")
    masked = unescaped(F.substr(seg, (F.col("loss_from") - F.col("at") + 1).cast("int"), F.col("loss_chars").cast("int")))
    parsed = turns.join(mine, same, "left").select("conv_id", F.struct("nth", role_of(seg).alias("role"), text_of(seg).alias("text"), "example", F.when(F.col("example").isNotNull(), masked).alias("loss"), (F.col("at") + F.length(seg)).alias("upto")).alias("t"))
    by = parsed.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    trained = F.filter("ts", lambda t: t.example.isNotNull())
    loss = F.array_join(F.transform(F.array_sort(F.transform(trained, lambda t: F.struct(t.example, t.loss))), lambda t: t.loss), "")
    said = F.array_join(F.transform("ts", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    zero = F.lit(0).cast("long")
    in_examples = F.aggregate(trained, zero, lambda a, t: a + t.upto)
    last = F.aggregate(trained, zero, lambda a, t: F.greatest(a, t.upto))
    all_chars = F.aggregate("ts", zero, lambda a, t: F.greatest(a, t.upto))
    by = by.select("conv_id", "ts", said.alias("said"), loss.alias("loss"), F.size(trained).cast("long").alias("n_examples"), (in_examples + all_chars - last).alias("formatted_chars"))
    return by.select("conv_id", F.size("ts").cast("long").alias("n_turns"), F.sha2("said", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples")
