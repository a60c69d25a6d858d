"""Alignment records as row-local array expressions: no explode and no shuffle per base."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyarc.functions.binding import let
from tallyarc.operators.contracts import guarded

OPS = "MIDNSHP=X"
INTS = "array<int>"


def cigar_ops(cigar: Column) -> Column:
    """array<struct<n,op>>; operations that do not rebuild the text fail."""
    def read(v):
        ops = F.transform(v["parts"], lambda p: F.struct(F.substr(p, F.lit(1), F.length(p) - 1).cast("int").alias("n"), F.right(p, F.lit(1)).alias("op")))
        return guarded(ops, F.array_join(v["parts"], "") != v["cigar"], "invalid CIGAR")

    return let(read, cigar=cigar, parts=F.regexp_extract_all(cigar, F.lit(rf"(?:0|[1-9]\d*)[{OPS}]"), 0))


def query_codes(ops: Column) -> Column:
    """One letter per query base: M aligned, I inserted, S clipped."""
    return F.flatten(F.transform(ops, lambda o: F.array_repeat(
        F.when(o["op"].isin("M", "=", "X"), "M").when(o["op"] == "I", "I").otherwise("S"),
        F.when(o["op"].isin("M", "=", "X", "I", "S", "H"), o["n"]).otherwise(0))))


def aligned_matches(md: Column) -> Column:
    """One boolean per aligned base from an MD tag; deleted bases have none."""
    tokens = F.regexp_extract_all(md, F.lit(r"(\d+|\^[A-Za-z]+|[A-Za-z])"), 1)
    return F.flatten(F.transform(tokens, lambda t: F.when(t.rlike(r"^\d+$"), F.array_repeat(F.lit(True), t.try_cast("int")))
                                 .when(t.startswith("^"), F.array().cast("array<boolean>")).otherwise(F.array(F.lit(False)))))


def deletions(ops: Column) -> Column:
    """array<struct<q,n>>: query offset and length of every deletion."""
    start = F.struct(F.lit(0).alias("q"), F.array().cast("array<struct<q:int,n:int>>").alias("d"))
    walked = F.aggregate(ops, start, lambda a, o: F.struct(
        (a["q"] + F.when(o["op"].isin("M", "=", "X", "I", "S", "H"), o["n"]).otherwise(0)).alias("q"),
        F.when(o["op"] == "D", F.concat(a["d"], F.array(F.struct(a["q"].alias("q"), o["n"].alias("n"))))).otherwise(a["d"]).alias("d")))
    return walked["d"]


def base_scores(codes: Column, matches: Column, dels: Column, reverse: Column) -> Column:
    """Score per query base, null where clipped: match +1, mismatch or insertion -2, deletion -2 per base
    charged to the neighbour; flipped to query order on the reverse strand."""
    places = lambda codes_, keep: F.filter(F.transform(codes_, lambda c, i: F.when(keep(c), i)), lambda i: i.isNotNull())

    def with_places(v):
        return let(with_charges, codes=v["codes"], matches=v["matches"], dels=v["dels"],
                   aligned=places(v["codes"], lambda c: c == "M"), others=places(v["codes"], lambda c: c != "M"), first=F.array_min(places(v["codes"], lambda c: c != "S")))

    def with_charges(v):
        base = F.when(F.size(v["aligned"]) == F.size(v["matches"]), F.sort_array(F.concat(
            F.zip_with(v["aligned"], v["matches"], lambda p, m: F.struct(p.alias("p"), F.when(m, 1).otherwise(-2).alias("s"))),
            F.transform(v["others"], lambda p: F.struct(p.alias("p"), F.when(F.get(v["codes"], p) == "I", -2).alias("s"))))))
        checked = guarded(base, F.size(v["aligned"]) != F.size(v["matches"]), "MD/CIGAR length mismatch")
        charges = F.transform(v["dels"], lambda d: F.struct(
            F.when(d["q"] > v["first"], d["q"] - 1).otherwise(F.get(v["aligned"], F.lit(0))).alias("at"), (-2 * d["n"]).alias("cost")))
        plain = F.transform(checked, lambda e: e["s"])
        return let(charged, scores=plain, charges=charges, at=F.sort_array(F.array_distinct(F.transform(charges, lambda c: c["at"]))))

    def charged(v):
        """The scores in pieces that end at a charged base: one copy, whatever the number of deletions."""
        def piece(at, k):
            start = F.when(k == 0, 0).otherwise(F.get(v["at"], k - 1) + 1)
            cost = F.aggregate(F.filter(v["charges"], lambda c: c["at"] == at), F.lit(0), lambda a, c: a + c["cost"])
            return F.concat(F.slice(v["scores"], start + 1, at - start), F.array(F.get(v["scores"], at) + cost))

        rest = F.coalesce(F.get(v["at"], F.size(v["at"]) - 1), F.lit(-1)) + 1
        tail = F.slice(v["scores"], rest + 1, F.size(v["scores"]))
        return F.when(F.size(v["at"]) == 0, v["scores"]).otherwise(F.flatten(F.concat(F.transform(v["at"], piece), F.array(tail))))

    scores = let(with_places, codes=codes, matches=matches, dels=dels)
    return F.when(reverse, F.reverse(scores)).otherwise(scores)


def edit_summary(ops: Column, md: Column, reverse: Column) -> Column:
    """struct<edit_score,qstart,qend,length,scored>: what base_scores() adds up to, worked out from the operations without a number per base."""
    zero = F.lit(0)
    init = F.struct(zero.alias("q"), F.lit(None).cast("int").alias("s"), zero.alias("e"), zero.alias("aligned"), zero.alias("inserted"), zero.alias("deleted"), F.lit(False).alias("leads"))

    def step(a, o):
        match, n = o["op"].isin("M", "=", "X"), o["n"]
        scored = (match | (o["op"] == "I")) & (n > 0)
        deleted, none = o["op"] == "D", a["s"].isNull()
        return F.struct(
            (a["q"] + F.when(match | o["op"].isin("I", "S", "H"), n).otherwise(0)).alias("q"),
            F.when(scored & none, a["q"]).otherwise(a["s"]).alias("s"), F.when(scored, a["q"] + n).otherwise(a["e"]).alias("e"),
            (a["aligned"] + F.when(match, n).otherwise(0)).alias("aligned"), (a["inserted"] + F.when(o["op"] == "I", n).otherwise(0)).alias("inserted"),
            # A deletion that follows clipped bases, behind scored ones, has no base to bear it.
            (a["deleted"] + F.when(deleted & (none | (a["e"] == a["q"])), n).otherwise(0)).alias("deleted"), (a["leads"] | (deleted & none)).alias("leads"))

    def summed(v):
        w, kept = v["walked"], v["kept"]
        matches = F.aggregate(F.filter(F.split(kept, "[^0-9]+"), lambda t: t != ""), F.lit(0), lambda a, t: a + t.cast("int"))
        return let(lambda u: result(w, u["matches"], u["changed"]), matches=matches, changed=F.length(F.regexp_replace(kept, "[^A-Za-z]", "")))

    def result(w, matches, changed):
        first, last = F.when(reverse, w["q"] - w["e"]).otherwise(w["s"]), F.when(reverse, w["q"] - w["s"]).otherwise(w["e"])
        some = w["s"].isNotNull()
        total = F.struct((matches - 2 * (changed + w["inserted"] + w["deleted"])).cast("long").alias("edit_score"), F.when(some, first).cast("long").alias("qstart"), F.when(some, last).cast("long").alias("qend"),
                         w["q"].cast("long").alias("length"), (w["aligned"] + w["inserted"]).cast("long").alias("scored"))
        bearable = F.when(~w["leads"] | (w["aligned"] > 0), total)
        return guarded(bearable, matches + changed != w["aligned"], "MD/CIGAR length mismatch")

    return let(summed, walked=F.aggregate(ops, init, step), kept=F.regexp_replace(md, r"\^[A-Za-z]+", " "))


def window_score(scores: Column, start: Column, end: Column) -> Column:
    """Sum over [start, end) with -2 for every position without a score."""
    return let(lambda v: F.aggregate(F.sequence(v["start"], v["end"] - 1), F.lit(0), lambda a, i: a + F.coalesce(
        F.get(v["scores"], i), F.lit(-2))), scores=scores, start=start, end=end)


def split_score(left: Column, right: Column, start: Column, end: Column) -> Column:
    """Two arms over one window; where both cover a position the lower score counts."""
    return let(lambda v: F.aggregate(F.sequence(v["start"], v["end"] - 1), F.lit(0), lambda a, i: a + F.coalesce(
        F.least(F.get(v["left"], i), F.get(v["right"], i)), F.lit(-2))), left=left, right=right, start=start, end=end)


def covered(scores: Column) -> Column:
    return F.size(F.filter(scores, lambda s: s.isNotNull()))


def reference_blocks(ops: Column, start: Column) -> Column:
    """array<struct<start,end>> of aligned reference; introns split, deletions stay inside."""
    empty = F.struct(start.cast("int").alias("r"), F.lit(True).alias("fresh"),
                     F.array().cast("array<struct<start:int,end:int>>").alias("b"))

    def step(a, o):
        uses = o["op"].isin("M", "=", "X", "D")
        span = F.struct(a["r"].alias("start"), (a["r"] + o["n"]).alias("end"))
        last = F.element_at(a["b"], -1)
        longer = F.concat(F.slice(a["b"], 1, F.size(a["b"]) - 1), F.array(F.struct(last["start"].alias("start"), (a["r"] + o["n"]).alias("end"))))
        blocks = F.when(uses & (a["fresh"] | (F.size(a["b"]) == 0)), F.concat(a["b"], F.array(span))).when(uses, longer).otherwise(a["b"])
        return F.struct((a["r"] + F.when(uses | (o["op"] == "N"), o["n"]).otherwise(0)).alias("r"),
                        F.when(o["op"] == "N", True).when(uses, False).otherwise(a["fresh"]).alias("fresh"), blocks.alias("b"))

    return F.aggregate(ops, empty, step)["b"]


def projected_positions(ops: Column, start: Column, reverse: Column) -> Column:
    """Reference position of every projected base: deletions restored, insertions omitted, introns skipped."""
    blocks = reference_blocks(ops, start)
    spread = F.flatten(F.transform(blocks, lambda b: F.sequence(b["start"], b["end"] - 1)))
    return F.when(reverse, F.reverse(spread)).otherwise(spread)


def projected_bases(ops: Column, read: Column, quality: Column, reference: Column, minimum: int = 30) -> Column:
    """array<struct<base,action>>: reference bases with high-quality substitutions kept.

    ``reference`` is the slice from the alignment start; letters are 1-character arrays. Low-quality
    differences take the reference, deletions are restored, insertions leave no base.
    """
    return let(lambda v: _project(v["ops"], v["read"], v["quality"], v["reference"], minimum),
               ops=ops, read=read, quality=quality, reference=reference)


def _project(ops: Column, read: Column, quality: Column, reference: Column, minimum: int) -> Column:
    piece = "array<struct<base:string,action:string>>"
    init = F.struct(F.lit(0).alias("q"), F.lit(0).alias("r"), F.array().cast(piece).alias("out"))

    def step(a, o):
        aligned, deleted = o["op"].isin("M", "=", "X"), o["op"] == "D"
        steps = F.when((aligned | deleted) & (o["n"] > 0), F.sequence(F.lit(0), o["n"] - 1)).otherwise(F.array().cast("array<int>"))

        def one(i):
            ref, seen = F.get(reference, a["r"] + i), F.get(read, a["q"] + i)
            good = F.get(quality, a["q"] + i) >= minimum
            action = (F.when(deleted, "restored").when(seen == ref, "same").when(good, "kept").otherwise("corrected"))
            return F.struct(F.when(aligned & good, seen).otherwise(ref).alias("base"), action.alias("action"))

        return F.struct((a["q"] + F.when(aligned | o["op"].isin("I", "S", "H"), o["n"]).otherwise(0)).alias("q"),
                        (a["r"] + F.when(aligned | deleted | (o["op"] == "N"), o["n"]).otherwise(0)).alias("r"),
                        F.concat(a["out"], F.transform(steps, one)).alias("out"))

    return F.aggregate(ops, init, step)["out"]


def projected_text(ops: Column, read: Column, quality: Column, reference: Column, minimum: int = 30, offset: int = 33) -> Column:
    """struct<text,bases,substitutions>: what projected_bases() gives for texts, quality coded from ``offset``.

    A stretch equal to its reference is copied whole; only one that differs is compared letter by letter.
    """
    init = F.struct(F.lit(0).alias("q"), F.lit(0).alias("r"), F.lit("").alias("text"), F.lit(0).alias("bases"), F.lit(0).alias("substitutions"))

    def differing(v):
        """Letters of one stretch: the reference's, or the read's where its quality is high."""
        def one(i):
            ref, seen = F.get(v["ref"], i), F.get(v["seen"], i)
            good = F.ascii(F.get(v["quality"], i)) - offset >= minimum
            return F.struct(F.when(good, seen).otherwise(ref).alias("base"), (~F.coalesce(seen == ref, F.lit(False))).alias("changed"))

        def counted(w):
            return F.struct(F.array_join(F.transform(w["letters"], lambda x: x["base"]), "").alias("text"), F.size(F.filter(w["letters"], lambda x: x["changed"])).alias("changed"))

        return let(counted, letters=F.transform(F.sequence(F.lit(0), v["n"] - 1), one))

    def stretch(v):
        same = F.struct(v["ref"].alias("text"), F.lit(0).alias("changed"))
        letters = lambda c: F.split(c, "")
        apart = let(differing, n=v["n"], ref=letters(v["ref"]), seen=letters(v["seen"]), quality=letters(v["quality"]))
        return F.when(v["deleted"] | ((v["seen"] == v["ref"]) & (F.length(v["ref"]) == v["n"])), same).otherwise(apart)

    def step(v):
        def walked(a, o):
            aligned, deleted = o["op"].isin("M", "=", "X"), o["op"] == "D"
            used = (aligned | deleted) & (o["n"] > 0)
            at = lambda c, start: F.coalesce(F.substr(c, start + 1, o["n"]), F.lit(""))
            got = let(stretch, n=o["n"], deleted=deleted, ref=at(v["reference"], a["r"]), seen=at(v["read"], a["q"]), quality=at(v["quality"], a["q"]))
            return let(lambda w: F.struct(
                (a["q"] + F.when(aligned | o["op"].isin("I", "S", "H"), o["n"]).otherwise(0)).alias("q"),
                (a["r"] + F.when(aligned | deleted | (o["op"] == "N"), o["n"]).otherwise(0)).alias("r"),
                F.concat(a["text"], F.coalesce(w["got"]["text"], F.lit(""))).alias("text"), (a["bases"] + F.when(used, o["n"]).otherwise(0)).alias("bases"),
                (a["substitutions"] + F.coalesce(w["got"]["changed"], F.lit(0))).alias("substitutions")), got=F.when(used, got))

        return F.aggregate(v["ops"], init, walked, lambda a: F.struct(a["text"].alias("text"), a["bases"].alias("bases"), a["substitutions"].alias("substitutions")))

    return let(step, ops=ops, read=read, quality=quality, reference=reference)
