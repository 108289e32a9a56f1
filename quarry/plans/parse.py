"""Documents to provisions: blocks, labels, the fold into a tree, validity, links.

Blocks and labels are cut row by row; the tree, its wordings, validity, pruning
and links are windows and joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.labels import classified, references
from quarry.functions.text import fragment_of, is_structural, normalise
from quarry.operators.temporal import validity
from quarry.operators.tree import prune_empty
from quarry.schema import BY_NAME, COMPONENT, STRUCTURAL, VERSION
from quarry.sources.html import blocks

#: Fixed value: the heading of the transitional part, in plain letters.
SECOND_PART = "ato das disposicoes constitucionais"

#: An anchor of an article: art12, art.12 and the like.
ARTICLE_ANCHOR = "(?i)^art[. ]?[0-9]"
LEVELS = sorted({k.level for k in BY_NAME.values()})


def _placed(cut: DataFrame) -> DataFrame:
    """Blocks with what they open: type, label, rest, segment, level (null: text that goes on), chain, whole and owner.

    chain are the blocks (pos, segment) that are open above, the outermost
    first: the last of each level, if none of an outer level came after it.
    whole is the path that they spell, and owner the last block that opened anything.
    """
    rows = cut.withColumn("_l", classified(F.col("text"))).withColumns({"type": F.col("_l.type"), "segment": F.col("_l.segment")})
    number = F.when(F.col("type") == "artigo", F.regexp_extract("segment", "^[a-z]+([0-9]+)", 1).cast("int"))
    earlier = lambda *keys: Window.partitionBy("norm_urn", *keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    # articles are numbered anew behind the first heading of the second part that follows an article
    numbered = rows.withColumn("number", number)
    heads = F.startswith(normalise(F.col("text")), F.lit(SECOND_PART)) & (F.max("number").over(earlier()) > 0)
    turned = numbered.withColumn("_turn", F.min(F.when(heads, F.col("pos"))).over(Window.partitionBy("norm_urn")))
    parts = turned.withColumn("second", F.coalesce(F.col("pos") > F.col("_turn"), F.lit(False))).where(F.col("_turn").isNull() | (F.col("pos") != F.col("_turn")))
    # an article below one that was met before is prose, unless the page has an anchor for it
    lower = (F.col("number") < F.max("number").over(earlier("second"))) & ~F.exists("anchors", lambda a: a.rlike(ARTICLE_ANCHOR))
    level = F.create_map(*[F.lit(x) for k in BY_NAME.values() for x in (k.name, k.level)])[F.col("type")]
    opens = parts.withColumn("level", F.when(F.coalesce(lower, F.lit(False)), F.lit(None)).otherwise(level))
    last = {n: F.max(F.when(F.col("level") == n, F.struct("pos", "segment"))).over(earlier("second")) for n in LEVELS}
    held = opens.withColumns({f"_last{n}": c for n, c in last.items()})
    outer = lambda n: F.greatest(F.lit(-1), F.lit(-1), *[F.coalesce(F.col(f"_last{m}.pos"), F.lit(-1)) for m in LEVELS if m < n])
    open_above = [F.when((F.col(f"_last{n}.pos") > outer(n)) & (F.lit(n) < F.col("level")), F.col(f"_last{n}")) for n in LEVELS]
    chain = F.filter(F.array(*open_above), lambda x: x.isNotNull())
    spelt = held.withColumn("chain", chain).withColumn("owner", F.max(F.when(F.col("level").isNotNull(), F.col("pos"))).over(Window.partitionBy("norm_urn").orderBy("pos")))
    whole = F.concat_ws("/", F.when(F.col("second"), F.lit(COMPONENT)), F.transform("chain", lambda x: x["segment"]), "segment")
    return spelt.withColumn("whole", whole).drop(*[f"_last{n}" for n in LEVELS], "_turn", "number")


def nodes(cut: DataFrame) -> DataFrame:
    """Blocks (norm_urn, pos, text, struck, anchors, note, action, year) to tree nodes, superseded wordings marked @N.

    All windows and joins.  A structural heading that is met again is the node
    it was.  Of the blocks that open one segment below one node the last is the
    current wording; each earlier one is marked with how many of its path were
    superseded by then.  Text that opens nothing goes on in the node before it.
    """
    from quarry.sources.store import Store

    store = Store.scratch(cut.sparkSession)
    store.rewrite("placed", _placed(cut))  # written once: the joins below read it again and again
    placed = store.read("placed")
    opened = placed.where(F.col("level").isNotNull())
    first = F.min("pos").over(Window.partitionBy("norm_urn", "whole"))
    known = opened.withColumn("node", F.when(F.col("type").isin(*STRUCTURAL), first).otherwise(F.col("pos")))
    ident = known.select("norm_urn", F.col("pos").alias("_at"), F.col("node").alias("_node"))
    as_node = lambda rows, at, name: rows.join(ident.select("norm_urn", F.col("_at").alias(at), F.col("_node").alias(name)), ["norm_urn", at], "left")

    own = known.where("node = pos").withColumn("_up", F.element_at(F.concat(F.array(F.lit(None).cast("int")), F.transform("chain", lambda x: x["pos"])), -1))
    below = as_node(own, "_up", "parent")
    siblings = Window.partitionBy("norm_urn", "second", "parent", "segment").orderBy("pos")
    worded = below.withColumn("_next", F.when(~F.col("type").isin(*STRUCTURAL), F.lead("pos").over(siblings)))
    nth = F.row_number().over(Window.partitionBy("norm_urn", "whole", F.col("_next").isNotNull()).orderBy("_next"))
    marked = worded.withColumn("final", F.when(F.col("_next").isNull(), F.col("segment")).otherwise(F.concat("segment", F.lit(VERSION), nth)))
    ordered = marked.withColumn("ordinal", F.row_number().over(Window.partitionBy("norm_urn", "parent").orderBy("pos")))

    above = as_node(ordered.select("norm_urn", "pos", F.posexplode("chain").alias("_n", "_a")).select("norm_urn", "pos", "_n", F.col("_a.pos").alias("_block")), "_block", "_of")
    finals = ordered.select("norm_urn", F.col("pos").alias("_of"), "final")
    spelt = above.join(finals, ["norm_urn", "_of"]).groupBy("norm_urn", "pos").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "final"))), lambda x: x["final"]).alias("_above"))
    more = as_node(placed.where(F.col("level").isNull() & (F.col("text") != "")), "owner", "node").where(F.col("node").isNotNull())
    gone_on = more.groupBy("norm_urn", F.col("node").alias("pos")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("_more"))

    full = ordered.join(spelt, ["norm_urn", "pos"], "left").join(gone_on, ["norm_urn", "pos"], "left")
    head = F.concat_ws("/", F.when(F.col("second"), F.lit(COMPONENT)), F.col("_above"))
    under = lambda segment: F.when(head == "", F.col(segment)).otherwise(F.concat(head, F.lit("/"), segment))
    text = F.when(F.col("_more").isNull(), F.col("_l.text")).otherwise(F.btrim(F.concat_ws(" ", "_l.text", "_more")))
    return full.select(
        "norm_urn", F.col("pos").cast("int").alias("pos"), under("final").alias("path"), F.when(F.size("chain") > 0, head).alias("parent_path"), under("segment").alias("base_path"),
        "type", F.col("_l.label").alias("label"), text.alias("text"), F.col("ordinal").cast("int").alias("ordinal"), "note", "action", F.col("year").cast("int").alias("year"), "struck",
    )


def warnings(cut: DataFrame) -> DataFrame:
    """(norm_urn, pos, reason, text): blocks that the tree takes for something else than they look like.

    An article whose number goes back is prose; a structural heading that is met
    again opens nothing new; text before the first node belongs to none.
    """
    placed = _placed(cut)
    first = F.min(F.when(F.col("type").isin(*STRUCTURAL), F.col("pos"))).over(Window.partitionBy("norm_urn", "whole", F.col("level").isNull()))
    reason = (
        F.when((F.col("type") == "artigo") & F.col("level").isNull(), "article number goes back")
        .when(F.col("type").isin(*STRUCTURAL) & (F.col("pos") > first), "heading met again")
        .when(F.col("level").isNull() & F.col("owner").isNull() & (F.col("text") != ""), "text before the first provision")
    )
    return placed.withColumn("reason", reason).where(F.col("reason").isNotNull()).select("norm_urn", F.col("pos").cast("int").alias("pos"), "reason", "text")


def provisions(documents: DataFrame) -> DataFrame:
    """Documents (norm_urn, published, html) to provisions as the store keeps them."""
    cut = blocks(documents.select("norm_urn", "html"), ["norm_urn"])
    tree = prune_empty(nodes(cut), is_structural(F.col("type")), F.col("type") == "artigo", ["norm_urn"])
    dated = tree.join(documents.select("norm_urn", "published"), "norm_urn")
    # a wording's end needs the next wording's start: both come from their notes
    valid = validity(dated.withColumn("valid_from", F.coalesce(F.make_date("year", F.lit(1), F.lit(1)), "published")), ["norm_urn", "base_path"], "pos", F.col("published"))
    urn = lambda p: F.concat("norm_urn", F.lit("!"), fragment_of(F.col(p)))
    return valid.select(urn("path").alias("id"), "norm_urn", F.when(F.col("parent_path").isNotNull(), urn("parent_path")).alias("parent_id"), "type", "label", "ordinal", "path", "text", "valid_from", "revoked_on", F.col("note").alias("amendment_note"))


def links(provision: DataFrame) -> DataFrame:
    """(origin_id, target_urn, original_text): references in the text to articles of the same norm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, target, said = [], [], []
            for n, text in enumerate(batch["text"].to_pylist()):
                for found in dict.fromkeys(references(text or "")):
                    row.append(n)
                    target.append(found[0])
                    said.append(found[1])
            of = pa.array(row, pa.int32())
            yield pa.record_batch({"origin_id": batch["id"].take(of), "norm_urn": batch["norm_urn"].take(of), "target": pa.array(target, pa.string()), "original_text": pa.array(said, pa.string())})

    listed = provision.select("id", "norm_urn", "text").mapInArrow(run, "origin_id string, norm_urn string, target string, original_text string")
    target = F.concat("norm_urn", F.lit("!"), "target")
    return listed.select("origin_id", target.alias("target_urn"), "original_text").where("origin_id <> target_urn").distinct()
