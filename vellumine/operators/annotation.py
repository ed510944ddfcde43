"""Repeat annotation: parsers, fragment assembly, dictionaries, selection (R8-R15, W1-W10, J11-J16,
A16, A17, N1-N8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.operators.intervals import gap_merge, lag_merge

# Classes that are not repeats of interest, and transposable-element classes.
NOT_REPEATS = ("Low_complexity", "Simple_repeat", "Satellite", "rRNA", "scRNA", "snRNA", "srpRNA", "tRNA")
TE_CLASSES = ("DNA", "SINE", "LINE", "LTR")
UNNAMED_FAMILIES = ("Unknown", "Other")
#: Marks of internal regions, in the order in which they are tried.
INTERNAL_MARKS = ("-int", "-in", "-i", "_int", "_in", "_i", "-INT", "-IN", "-I", "_INT", "_IN", "_I")

IDENTITY = lambda df: df  # noqa: E731  (R15)


def basic_parser(rmsk: DataFrame) -> DataFrame:
    """Filter, clean and name repeats (N1): duplicates of a name are numbered in ``frag_id`` order."""
    df = rmsk.filter(~F.col("rep_class").isin(*NOT_REPEATS) & F.col("strand").isin("+", "-"))
    for c in ("rep_name", "rep_class", "rep_family"):
        df = df.withColumn(c, F.translate(c, "?", ""))
    w = Window.partitionBy("rep_name")
    n, k = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy("frag_id"))
    df = df.withColumn("name", F.when(n > 1, F.concat("rep_name", F.lit("_dup"), k.cast("string"))).otherwise(F.col("rep_name")))
    return df.withColumn("rep_family", F.when(F.col("rep_family").isin(*UNNAMED_FAMILIES), F.col("rep_name")).otherwise(F.col("rep_family")))


def only_tes(rmsk: DataFrame) -> DataFrame:
    """Rolling-circle helitrons count as DNA; keep the four element classes."""
    rc = (F.col("rep_class") == "RC") & (F.col("rep_family") == "Helitron")
    df = rmsk.withColumn("_rc", rc).withColumn("rep_class", F.when(F.col("_rc"), "DNA").otherwise(F.col("rep_class"))).withColumn("rep_family", F.when(F.col("_rc"), "RC").otherwise(F.col("rep_family")))
    return df.drop("_rc").filter(F.col("rep_class").isin(*TE_CLASSES))


def consensus_lengths(rmsk: DataFrame, length: Column | str = "cons") -> DataFrame:
    """Most frequent consensus length per name, the smaller one of ties."""
    counts = rmsk.groupBy("rep_name", F.col(length).alias("cons_len") if isinstance(length, str) else length.alias("cons_len")).count()
    return counts.groupBy("rep_name").agg(F.min_by("cons_len", F.struct(-F.col("count"), F.col("cons_len"))).alias("cons_len"))


def consensus_end() -> Column:
    """A fragment's consensus length (A16): its end there and what remains, as positions are given by
    strand (rep_left on '+', rep_start on '-'), signs aside; no strand: its end."""
    remain = F.when(F.col("strand") == "+", F.abs("rep_left")).when(F.col("strand") == "-", F.abs("rep_start")).otherwise(0)
    return F.col("rep_end") + remain


def consensus_start() -> Column:
    """A fragment's start in the consensus (W7): rep_start on '+', else rep_left; past its end, the
    place after the end."""
    start = F.when(F.col("strand") == "+", F.abs("rep_start")).otherwise(F.abs("rep_left"))
    return F.when(start > F.col("rep_end"), F.col("rep_end") + 1).otherwise(start)


def is_internal(name: Column) -> Column:
    return name.rlike("(?i)-int|-in|-i|_int|_in|_i")


def is_ltr(name: Column) -> Column:
    return name.rlike("(?i)LTR") & ~is_internal(name)


def _first_seen(names: DataFrame) -> DataFrame:
    """Distinct names with the order of their first appearance, by ``ix`` (names' own order without it)."""
    ix = F.min("ix") if "ix" in names.columns else F.min("rep_name")
    return names.groupBy("rep_name").agg(ix.alias("_ix"))


def prefix_dictionary(names: DataFrame, least: int = 5, share: float = 0.5) -> DataFrame:
    """LTR to internal region by the longest common prefix (J14): its length plus one must exceed
    ``least`` and be at least ``share`` of the LTR's name; of equally good regions the one that appears
    first stays. ``names``: rep_name of LTR-class rows and ``ix``, the order of rows. Gives ltr_name,
    int_name and ltr_ix, the LTR's first place. Candidates are joined on the first ``least``
    characters, which any match of that length shares, so nothing is crossed."""
    uniq = _first_seen(names).withColumn("_k", F.substring("rep_name", 1, least))
    ltrs = uniq.filter(is_ltr(F.col("rep_name"))).select(F.col("rep_name").alias("ltr_name"), F.col("_ix").alias("ltr_ix"), "_k")
    ints = uniq.filter(is_internal(F.col("rep_name"))).select(F.col("rep_name").alias("int_name"), F.col("_ix").alias("_int_ix"), "_k")
    shorter = F.least(F.length("ltr_name"), F.length("int_name"))
    common = F.size(F.filter(F.sequence(F.lit(1), shorter), lambda k: F.substr(F.col("ltr_name"), F.lit(1), k) == F.substr(F.col("int_name"), F.lit(1), k)))
    pairs = ltrs.join(ints, "_k").filter(F.length("_k") == least).withColumn("score", (common + 1) / F.length("ltr_name"))
    pairs = pairs.filter((common + 1 >= least + 1) & (F.col("score") >= share))
    return pairs.groupBy("ltr_name", "ltr_ix").agg(F.min_by("int_name", F.struct(-F.col("score"), F.col("_int_ix"))).alias("int_name")).select("ltr_name", "int_name", "ltr_ix")


def inverse_dictionary(dictionary: DataFrame) -> DataFrame:
    """Internal region to its LTRs, joined by ':' in order."""
    order = "ltr_ix" if "ltr_ix" in dictionary.columns else "ltr_name"
    found = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "ltr_name"))), lambda x: x["ltr_name"])
    return dictionary.groupBy("int_name").agg(F.array_join(found, ":").alias("ltr_names"))


def rule_dictionary(names: DataFrame, fuzzy: bool = False) -> DataFrame:
    """LTR to internal region by naming rules (J11-J13, J15), as pairs (ltr_name, int_name).

    Rules in order, a later one overwriting: the LTR mark replaced by an internal mark; an
    internal mark appended; both. What is left is matched on simplified names, and if ``fuzzy``
    on names without a last letter, a last digit or two last characters, in that order: each pass
    gives an LTR that has none yet the first region in name order."""
    uniq = names.select("rep_name").distinct()
    internal, ltr = is_internal(F.col("rep_name")), is_ltr(F.col("rep_name"))
    undecided = ~internal & ~ltr
    ints = uniq.filter(internal | undecided).select(F.col("rep_name").alias("int_name"))
    ltrs = uniq.filter(ltr | undecided).select(F.col("rep_name").alias("ltr_name"))
    keys = []
    for k, mark in enumerate(INTERNAL_MARKS):
        keys.append((k, F.regexp_replace("ltr_name", "[-_]LTR|LTR", mark)))
        keys.append((100 + k, F.concat("ltr_name", F.lit(mark))))
        for j, sub in enumerate(("I", "IN", "INT", "i", "in", "int")):
            keys.append((200 + 10 * k + j, F.concat(F.regexp_replace("ltr_name", "LTR", sub), F.lit(mark))))
    tried = ltrs.withColumn("c", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), key.alias("key")) for r, key in keys])))
    ruled = tried.join(ints, (F.col("c.key") == F.col("int_name")) & (F.col("ltr_name") != F.col("int_name")))
    ruled = ruled.groupBy("ltr_name").agg(F.max_by("int_name", "c.rule").alias("int_name"))

    plain_ltr = F.regexp_replace(F.when(F.col("ltr_name").startswith("LTR"), F.col("ltr_name")).otherwise(F.regexp_replace("ltr_name", "LTR", "")), "[-_]", "")
    plain_int = F.regexp_replace(F.regexp_replace(F.regexp_replace("int_name", "(?i)int|in", ""), "[-_]I", ""), "[-_]", "")
    left = ltrs.join(ruled, "ltr_name", "left_anti").join(ruled.select(F.col("int_name").alias("ltr_name")), "ltr_name", "left_anti").withColumn("pl", plain_ltr)
    right = ints.join(ruled.select(F.col("ltr_name").alias("int_name")), "int_name", "left_anti").withColumn("pi", plain_int)
    out = ruled.unionByName(left.join(right, (F.col("pl") == F.col("pi")) & (F.col("ltr_name") != F.col("int_name"))).select("ltr_name", "int_name"))
    for pattern in ("(?i)[a-z]$", "(?i)[0-9]$", "(?i)[a-z0-9][a-z0-9]$") if fuzzy else ():
        l = left.join(out, "ltr_name", "left_anti").withColumn("sl", F.regexp_replace("pl", pattern, ""))
        r = right.join(out.select(F.col("ltr_name").alias("int_name")), "int_name", "left_anti").withColumn("si", F.regexp_replace("pi", pattern, ""))
        one = l.join(r, (F.col("pl") == F.col("si")) & (F.col("ltr_name") != F.col("int_name"))).select("ltr_name", "int_name")
        two = l.join(r, (F.col("sl") == F.col("pi")) & (F.col("ltr_name") != F.col("int_name"))).select("ltr_name", "int_name")
        out = out.unionByName(one.unionByName(two).groupBy("ltr_name").agg(F.min("int_name").alias("int_name")))
    return out


def counterpart_rank(frags: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Ranks that pre-split LTRs and internal regions (J8): for an LTR fragment the internal
    fragments with a larger start, for an internal one the LTR fragments with a smaller start, of
    the same pair, sequence and strand. Adds ``role`` (LTR, int, noLTR) and ``cut``."""
    d = dictionary.select(F.col("ltr_name").alias("_l"), F.col("int_name").alias("_i"))
    ints = d.select(F.col("_i").alias("_n")).distinct().withColumn("_int", F.lit(True))
    df = frags.join(d, F.col("rep_name") == F.col("_l"), "left").join(ints, F.col("rep_name") == F.col("_n"), "left")
    pair = F.when(F.col("_int"), F.col("rep_name")).otherwise(F.col("_i"))
    df = df.withColumn("pair", pair).withColumn("_is_int", F.coalesce("_int", F.lit(False)).cast("int")).withColumn("_is_ltr", F.col("_i").isNotNull().cast("int"))
    whole = Window.partitionBy("pair", "seqname", "strand")
    # Both frames grow from their window's start: one that shrinks towards its end is summed anew at each row.
    up, down = whole.orderBy(F.col("g_start").asc_nulls_last()), whole.orderBy(F.col("g_start").desc_nulls_first())
    later = F.coalesce(F.sum("_is_int").over(down.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    earlier = F.coalesce(F.sum("_is_ltr").over(up.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    both = F.col("pair").isNotNull() & (F.sum("_is_int").over(whole) > 0) & (F.sum("_is_ltr").over(whole) > 0)
    role = F.when(both & (F.col("_is_int") == 1), "int").when(both & (F.col("_is_ltr") == 1), "LTR").otherwise("noLTR")
    df = df.withColumn("role", role).withColumn("cut", F.when(F.col("role") == "int", earlier).when(F.col("role") == "LTR", later).otherwise(0).cast("long"))
    return df.drop("_l", "_i", "_n", "_int", "_is_int", "_is_ltr")


def merge_fragments(frags: DataFrame, insert: int, lag: bool = False) -> DataFrame:
    """Fragments (from ``counterpart_rank``) to elements (W4 or W6): name, place, extent, width sum,
    divergence, role, pair."""
    keys = ["rep_name", "seqname", "strand", "cut"]
    m = lag_merge(frags, keys, F.col("strand") == "-") if lag else gap_merge(frags, keys, insert)
    return m.groupBy(*keys, "island", "role", "pair").agg(
        F.min("g_start").alias("g_start"), F.max("g_end").alias("g_end"), F.sum(F.col("g_end") - F.col("g_start") + 1).alias("width"),
        F.avg("milli_div").alias("milli_div"), F.sum("milli_div").alias("div_sum"), F.count(F.lit(1)).alias("n_frags"), F.min("frag_id").alias("elem_id"),
        *[F.min("rep_class").alias("rep_class")] * ("rep_class" in m.columns),
    )


def ltr_int_patterns(elements: DataFrame, cons: DataFrame, parity: bool = True) -> DataFrame:
    """Neighbour pattern LTR, int, LTR (W8, W9): adds ``up`` and ``down`` (the internal region's LTR
    on that side belongs to it and is nearer than half the consensus length). With ``parity`` the
    downstream distance is held against the upstream neighbour's consensus, as in the method's
    published form. An LTR that two regions claim stays with the first."""
    e = elements.filter("role <> 'noLTR'").join(cons, "rep_name", "left")
    w = Window.partitionBy("seqname", "strand").orderBy("g_start", "elem_id")
    near = lambda c, f: f(c).over(w)
    mine = F.col("role") == "int"
    up_ok = (near("role", F.lag) == "LTR") & (near("pair", F.lag) == F.col("pair"))
    down_ok = (near("role", F.lead) == "LTR") & (near("pair", F.lead) == F.col("pair"))
    up_near = F.col("g_start") - near("g_end", F.lag) < near("cons_len", F.lag) / 2
    reach = F.coalesce(near("cons_len", F.lag), F.col("cons_len")) if parity else near("cons_len", F.lead)
    down_near = near("g_start", F.lead) - F.col("g_end") < reach / 2
    e = e.withColumn("up0", F.coalesce(mine & up_ok & up_near, F.lit(False))).withColumn("down", F.coalesce(mine & down_ok & down_near, F.lit(False)))
    taken = F.coalesce(F.lag("down", 2).over(w), F.lit(False))
    return e.withColumn("up", F.col("up0") & ~taken).drop("up0")


def assemble(elements: DataFrame, cons: DataFrame) -> DataFrame:
    """Elements with ``status`` and ``assembly`` (W10, N7): the LTRs of a full or partial element
    carry its internal region's id, everything else its own."""
    p = ltr_int_patterns(elements, cons)
    w = Window.partitionBy("seqname", "strand").orderBy("g_start", "elem_id")
    status = F.when(F.col("up") & F.col("down"), "full-lengthLTR").when(F.col("up"), "partialLTR_up").when(F.col("down"), "partialLTR_down")
    p = p.withColumn("own", status)
    prev_down, next_up = F.coalesce(F.lag("down").over(w), F.lit(False)), F.coalesce(F.lead("up").over(w), F.lit(False))
    ltr = F.col("role") == "LTR"
    p = p.withColumn("assembly", F.when(ltr & prev_down, F.lag("elem_id").over(w)).when(ltr & next_up, F.lead("elem_id").over(w)).otherwise(F.col("elem_id")))
    p = p.withColumn("status", F.when(ltr & prev_down, F.lag("own").over(w)).when(ltr & next_up, F.lead("own").over(w)).otherwise(F.coalesce("own", "role")))
    rest = elements.filter("role = 'noLTR'").withColumn("assembly", F.col("elem_id")).withColumn("status", F.lit("noLTR"))
    return p.select(*rest.columns).unionByName(rest)


def strict(elements: DataFrame) -> DataFrame:
    """80-80 rule (R14): at least 80 bases and a mean divergence under 200 per mille."""
    return elements.filter((F.col("width") >= 80) & (F.col("milli_div") < 200))


def relative_length(assembled: DataFrame, cons: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Element table with ``rel_length`` (A17): width over consensus length; for elements with an
    internal region, of the region and twice its first LTR (null if that is unknown); at most 1.
    Where elements have ``rep_class``, so do these, as ``Class`` (N8)."""
    first_ltr = dictionary.groupBy("int_name").agg(F.min_by("ltr_name", F.col("ltr_ix" if "ltr_ix" in dictionary.columns else "ltr_name")).alias("_ltr"))
    lead = F.min_by("rep_name", F.struct(F.when(F.col("role") == "int", 0).otherwise(1), F.col("elem_id")))
    e = assembled.groupBy("assembly", "status", "seqname", "strand").agg(lead.alias("rep_name"), F.max((F.col("role") == "int").cast("int")).alias("_int"), F.min("g_start").alias("g_start"), F.max("g_end").alias("g_end"), F.sum("width").alias("width"), (F.sum("div_sum") / F.sum("n_frags")).alias("milli_div"), *[F.min("rep_class").alias("Class")] * ("rep_class" in assembled.columns))
    e = e.join(cons, "rep_name", "left").join(first_ltr, F.col("rep_name") == F.col("int_name"), "left")
    e = e.join(cons.select(F.col("rep_name").alias("_ltr"), F.col("cons_len").alias("_ltr_len")), "_ltr", "left")
    whole = F.when(F.col("_int") == 1, F.col("cons_len") + 2 * F.col("_ltr_len")).otherwise(F.col("cons_len"))
    return e.withColumn("rel_length", F.least(F.col("width") / whole, F.lit(1.0))).drop("_int", "_ltr", "_ltr_len", "int_name", "cons_len")


def assembly_parser(rmsk: DataFrame, is_strict: bool = False, insert: int = 1000, dictionary: DataFrame | None = None, cons: DataFrame | None = None, lag: bool = False) -> DataFrame:
    """Fragment tables to elements (N2, N5, N6): dictionary, merge, pattern, strict, relative length.
    ``insert`` under 0 or ``lag`` takes the consensus-guided merge."""
    te = only_tes(rmsk) if "rep_class" in rmsk.columns else rmsk
    dictionary = dictionary if dictionary is not None else prefix_dictionary(te.withColumn("ix", F.col("frag_id")))
    if "rep_end" in te.columns:
        te = te.withColumn("cons", consensus_end()).withColumn("c_start", consensus_start()).withColumn("c_end", F.col("rep_end"))
    cons = cons if cons is not None else consensus_lengths(te)
    if lag or insert < 0:
        te = te.join(cons, "rep_name", "left")
    elements = merge_fragments(counterpart_rank(te, dictionary), insert, lag or insert < 0)
    out = relative_length(assemble(elements, cons), cons, dictionary)
    return strict(out) if is_strict else out


STATUS = {"fullLength": ("full-lengthLTR",), "partial": ("partialLTR_up", "partialLTR_down"), "soloLTR": ("LTR",), "otherLTR": ("int", "noLTR")}


def get_ltrs(annot: DataFrame, rel_length: float = 0.9, full_length: bool = True, partial: bool = False, solo_ltr: bool = False, other_ltr: bool = False, return_mask: bool = False) -> DataFrame:
    """LTR elements by status and relative length (R10); ``return_mask`` adds a column instead."""
    chosen = [s for on, key in ((full_length, "fullLength"), (partial, "partial"), (solo_ltr, "soloLTR"), (other_ltr, "otherLTR")) if on for s in STATUS[key]]
    if not chosen:
        raise ValueError("at least one kind of LTR must be asked for")
    return _select(annot, "LTR", rel_length, return_mask, F.col("status").isin(*chosen))


def _select(annot: DataFrame, cls: str, rel_length: float, return_mask: bool, more: Column | None = None) -> DataFrame:
    ok = (F.col("rep_class") == cls) & (F.col("rel_length") > rel_length)
    if "is_te" in annot.columns:
        ok &= F.col("is_te")
    ok = F.coalesce(ok & more if more is not None else ok, F.lit(False))
    return annot.withColumn("mask", ok) if return_mask else annot.filter(ok)


def get_lines(annot: DataFrame, rel_length: float = 0.9, return_mask: bool = False) -> DataFrame:
    return _select(annot, "LINE", rel_length, return_mask)  # R11


def get_sines(annot: DataFrame, rel_length: float = 0.9, return_mask: bool = False) -> DataFrame:
    return _select(annot, "SINE", rel_length, return_mask)  # R12


def get_dna_transposons(annot: DataFrame, rel_length: float = 0.9, return_mask: bool = False) -> DataFrame:
    return _select(annot, "DNA", rel_length, return_mask)  # R13
