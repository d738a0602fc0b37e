"""Benchmark decontamination by template canonicalisation. DataFrame functions only.

Texts become token templates: numbers, names and units after a number turn into typed
placeholders, all else is lower-cased; punctuation only separates. A run of name words,
or of numbers, is one placeholder, so that names of one and of two words meet. Every
capitalised word is a name; as the first word of an item may stand in lower case within
a document's sentence, items are looked up with that word as a name and as a word.
Beside the templates stand the literal, lower-cased tokens: a verbatim copy is found
whatever precedes it and whatever its case.

Windows of ``window`` tokens of either form are hashed and joined with the benchmark's,
so a question whose numbers or names were changed still meets its original. Items of
fewer than ``window`` tokens (but at least ``shortest``) are one window of their own
length. A window is looked up by its anchor, the word of the greatest weight in it: a
document's window is hashed only where a benchmark anchor stands at the anchor's offset, which
loses none. Windows of placeholders alone have no anchor; they can be part of a copy, but
name no source.

A word's weight follows from the share of the corpus's documents that hold it: 1 up to one
document in a hundred, falling with the logarithm of the share to 0 for a word that all hold;
a thousand documents without it are added, so that small tables know no common words.

Diagonals (document position less item position) within the item's length of each other make
a band; every diagonal lies in two bands that overlap by half, so a copy into which words were
put, or from which they were left out, lies in one of them. In a band an item window stands
at its place on the diagonal with the most windows; a band is a candidate copy if the windows
found cover ``cover`` of the item's. An item token stands against the document's token on
the diagonal of a window that covers it, else on the band's main diagonal.

A pair is reported if any of its copies passes: the aligned tokens agree at that share of
the item, and
- in templates the agreeing words weigh ``evidence`` at least, and either each value of the
  item stands against one value of the document in most of its places (a first or last slot
  is judged unless its run goes on in the document), or the tokens and the slots agree
  literally at that share;
- in literal tokens nothing further.

Arrays are unfolded with the outer generators on purpose: for the plain ones Spark
infers a filter on the array's size and pushes its whole expression below, into the
lambdas, where the tokens would be made anew for every window.

A document of one sentence repeated gives a row per place and item window, never a list of
all of them: what is gathered in a row is bounded by the item's length. The documents' windows
are never shuffled unless the benchmark's windows exceed ``broadcast_rows`` (16 bytes each); then
both sides are hash-partitioned, every window of the benchmark ``salts`` times, so that a window
that very many documents share is met in as many tasks.

Edge cases: null and empty texts and items match nothing; items below ``shortest``
tokens are skipped, they identify no source; repeated items are reported under each of
their ids; rows that repeat a document id are matched as one document; texts of any length
are read whole, by the task that holds the row; null ids are skipped; empty tables give an
empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.llm.common import store

#: Units recognised after a number: fixed values, as text.
UNITS = ("kg g mg lb lbs oz ton tons km m cm mm mi mile miles ft feet inch inches yd l ml h hr hrs hour hours min mins minute minutes s sec "
         "second seconds day days week weeks month months year years percent usd eur gbp dollar dollars euro euros cent cents c f kb mb gb tb "
         "hz khz mhz ghz w kw mw v kmh mph degrees")
NAME_MARK, UNIT_MARK, JOINED = "\u0001", "\u0002", "\u0003"
#: Forms of a text that windows are made of; items have the first two as templates.
TEMPLATE, FIRST_WORD, LITERAL = 0, 1, 2
KINDS = {"number": -1, "name": -2, "unit": -3}


def marked(text: Column, names: str = "inside") -> Column:
    """``text`` with a mark before each name and unit, symbols as spaces, digits apart from letters.

    ``names``: which capitalised words are names: those ``inside`` a sentence, each its own
    token; ``all`` or all ``but first``, runs of names and of numbers joined; or ``none``,
    then without marks of units too.
    """
    units = "|".join(UNITS.split())
    # symbols and runs of white space become one space, so that they hide no name or unit
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}.,;:!?]+", " ")
    # each pattern starts with a character of its own: a look behind would be tried at every place
    t = F.regexp_replace(t, r"[.,](?<=[0-9][.,])(?=[0-9])", "")
    t = F.regexp_replace(t, r"[0-9](?=\p{L})", "$0 ")
    if names != "none":
        if names == "but first":
            t = F.regexp_replace(t, r"^[^\p{L}\p{N}]+", "")
        start = {"inside": r"(?<=[\p{L}\p{N},;]\s)", "all": r"(?<![\p{L}\p{N}])", "but first": r"(?<![\p{L}\p{N}])(?<!^)"}[names]
        t = F.regexp_replace(t, rf"(?=\p{{Lu}}\p{{Ll}}){start}", NAME_MARK)
        t = F.regexp_replace(t, rf"\s(?<=[0-9]\s)(?=(?i:{units})(?!\p{{L}}))", f"$0{UNIT_MARK}")
        if names != "inside":
            gap = r"[^\p{L}\p{N}\x01\x02]+"
            t = F.regexp_replace(t, rf"(\x01[\p{{L}}\p{{N}}]+){gap}(?=\x01)", f"$1{JOINED}")
            t = F.regexp_replace(t, rf"(?=[0-9])(?<![\p{{L}}\p{{N}}])([0-9]+){gap}(?=[0-9])", f"$1{JOINED}")
    return t


def cut(t: Column) -> Column:
    """Lower-cased tokens of a marked text; names carry a mark in front, units another, numbers start with a digit."""
    return F.filter(F.split(F.lower(t), r"[^\p{L}\p{N}\x01-\x03]+"), lambda w: w != "")


def cut_plain(t: Column) -> Column:
    """Lower-cased tokens of a marked text without its marks: what ``none`` would have given."""
    return F.filter(F.split(F.lower(t), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def tokens(text: Column, names: str = "inside") -> Column:
    """Tokens of a text; see ``marked`` and ``cut``."""
    return cut(marked(text, names))


def template(toks: Column) -> Column:
    """A long per token: its hash, or the kind of its slot."""
    return F.transform(toks, lambda w: F.when(w < "0", F.when(w < UNIT_MARK, KINDS["name"]).otherwise(KINDS["unit"]))
                       .when(w < ":", KINDS["number"]).otherwise(F.xxhash64(w)))


def literal(toks: Column) -> Column:
    """A long per token: its hash."""
    return F.transform(toks, lambda w: F.xxhash64(w))


def window_hash(values: Column, at: Column, size: Column | int) -> Column:
    """Hash of the run of ``size`` tokens from position ``at`` (from 0): that of the tokens one after the other."""
    return F.xxhash64(F.slice(values, at + 1, size))


def is_word(toks: Column, form: Column) -> Column:
    """Whether a token is no slot of its form."""
    return (form == LITERAL) | (toks >= ":")


def benchmark_items(items: DataFrame, window: int, shortest: int) -> DataFrame:
    """(item, form, key, n_tokens, size, toks, temp) of every usable item in each of its forms."""
    forms = {TEMPLATE: "all", FIRST_WORD: "but first", LITERAL: "none"}
    each = [F.struct(F.lit(k).alias("form"), tokens(F.col("text"), names).alias("toks")) for k, names in forms.items()]
    t = items.where(F.col("item").isNotNull()).select("item", F.explode(F.array(*each)).alias("f")).select("item", "f.form", "f.toks").distinct()
    t = t.withColumn("temp", F.when(F.col("form") == LITERAL, literal(F.col("toks"))).otherwise(template(F.col("toks"))))
    t = t.withColumn("n_tokens", F.size("toks")).where(F.col("n_tokens") >= shortest)
    return t.withColumn("size", F.least("n_tokens", F.lit(window))).withColumn("key", F.xxhash64("item", "form", "toks"))


def word_weights(texts: DataFrame, items: DataFrame) -> DataFrame:
    """(word, weight) of the benchmark's words, from the documents that hold them; others weigh 1."""
    words = items.select("form", F.explode("toks").alias("t")).where(is_word(F.col("t"), F.col("form"))).select(F.xxhash64("t").alias("word")).distinct()
    held = texts.select(F.array_distinct(F.transform(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: F.xxhash64(w))).alias("words"))
    found = held.select(F.explode_outer("words").alias("word")).join(words, "word").groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    total = texts.agg(F.count(F.lit(1)).alias("total"))
    share = (F.col("df") + 1) / (F.lit(total.first()[0]) + 1000)
    return found.select("word", F.greatest(F.lit(0.0), F.least(F.lit(1.0), -F.log10(share) / 2)).alias("weight"))


def with_weights(items: DataFrame, weights: DataFrame) -> DataFrame:
    """``items`` with ``weights``, one per token, null for slots."""
    each = items.select("key", "form", F.posexplode("toks").alias("at", "t")).select("key", "at", F.when(is_word(F.col("t"), F.col("form")), F.xxhash64("t")).alias("word"))
    each = each.join(weights, "word", "left").withColumn("weight", F.when(F.col("word").isNotNull(), F.coalesce("weight", F.lit(1.0))))
    per = each.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "weight"))).alias("w")).select("key", F.col("w.weight").alias("weights"))
    return items.join(per, "key")


def benchmark_windows(items: DataFrame) -> DataFrame:
    """(key, literal, at_item, size, hash, anchor, offset) of every window that holds a word."""
    spot = F.explode(F.sequence(F.lit(0), F.col("n_tokens") - F.col("size"))).alias("at_item")
    w = items.select("key", (F.col("form") == LITERAL).alias("literal"), "size", "temp", "weights", spot)
    w = w.withColumn("inside", F.slice("weights", F.col("at_item") + 1, F.col("size")))
    w = w.withColumn("offset", (F.array_position("inside", F.array_max("inside")) - 1).cast("int")).where(F.col("offset").isNotNull())
    return w.select("key", "literal", "at_item", "size", window_hash(F.col("temp"), F.col("at_item"), F.col("size")).alias("hash"),
                    F.get("temp", F.col("at_item") + F.col("offset")).alias("anchor"), "offset")


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are worked out once: a generator keeps Spark from moving them into the lambdas that read them."""
    kept = [c for c in df.columns if c not in columns]
    one = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select(*kept, F.explode_outer(F.array(one)).alias("c")).select(*kept, "c.*")


def align(both: DataFrame) -> DataFrame:
    """``both`` with ``same`` (item positions that agree), ``n_equal``, ``weight`` of the agreeing words and the ``slots`` of each copy.

    A row has an item (form, toks, temp, weights, n_tokens, size), the document's tokens around one
    copy (d_toks, the first at position ``low``), its main ``diagonal`` and the ``places`` of its windows.
    """
    index = F.sequence(F.lit(0), F.col("n_tokens") - 1)
    at = lambda c, i: F.get(F.col(c), i)
    d_temp = F.when(F.col("form") == LITERAL, literal(F.col("d_toks"))).otherwise(template(F.col("d_toks")))
    spots = F.map_from_entries(F.transform("places", lambda p: F.struct(p["at_item"], p["diagonal"])))
    both = computed(both, d_temp=d_temp, spots=spots)
    both = computed(both, of_window=F.transform(index, lambda i: F.try_element_at("spots", i)))
    # a window that covers the token: the one that starts there, or up to window - 1 before
    covering = lambda i: F.array_max(F.transform(F.filter(F.sequence(F.greatest(F.lit(0), i - F.col("size") + 1), i), lambda j: at("of_window", j).isNotNull()),
                                                 lambda j: F.struct(j.alias("j"), at("of_window", j).alias("d"))))["d"]
    both = computed(both, far=F.transform(index, lambda i: i + F.coalesce(covering(i), F.col("diagonal")) - F.col("low")))
    both = computed(both, same=F.filter(index, lambda i: (at("far", i) >= 0) & at("temp", i).eqNullSafe(at("d_temp", at("far", i)))))
    slots = F.transform(F.filter("same", lambda i: at("temp", i).between(-3, -1)),
                        lambda i: F.struct(at("temp", i).alias("kind"), at("toks", i).alias("mine"), at("d_toks", at("far", i)).alias("theirs"),
                                           ((i == 0) | (i == F.col("n_tokens") - 1)).alias("edge")))
    n_equal = F.size(F.filter("same", lambda i: at("toks", i) == at("d_toks", at("far", i))))
    weight = F.aggregate("same", F.lit(0.0), lambda acc, i: acc + F.coalesce(at("weights", i), F.lit(0.0)))
    both = computed(both, slots=slots, n_equal=n_equal, weight=weight)
    # the run of a first or last slot may go on in the document: it then has more parts
    goes_on = lambda s: s["edge"] & (F.size(F.split(s["theirs"], JOINED)) > F.size(F.split(s["mine"], JOINED)))
    values = F.transform(F.filter("slots", lambda s: ~goes_on(s)), lambda s: F.struct(s["kind"].cast("long").alias("kind"), s["mine"].alias("mine"), s["theirs"].alias("theirs")))
    return computed(both, judged=values)


def one_value_each(judged: str) -> Column:
    """Whether each value of the item has one value of the document in most of its places: one pass over the sorted slots."""
    zero = F.lit(0)
    start = F.struct(F.lit(None).cast("struct<kind:bigint,mine:string,theirs:string>").alias("slot"), zero.alias("run"), zero.alias("best"), zero.alias("all"), F.lit(True).alias("steady"))
    closed = lambda a: a["steady"] & ((a["all"] == 0) | (2 * a["best"] > a["all"]))

    def step(a, s):
        slot = F.struct(s["kind"].alias("kind"), s["mine"].alias("mine"), s["theirs"].alias("theirs"))
        mine = a["slot"].isNotNull() & (a["slot"]["kind"] == s["kind"]) & (a["slot"]["mine"] == s["mine"])
        run = F.when(mine & (a["slot"]["theirs"] == s["theirs"]), a["run"] + 1).otherwise(1)
        return F.struct(slot.alias("slot"), run.alias("run"), F.when(mine, F.greatest(a["best"], run)).otherwise(run).alias("best"),
                        F.when(mine, a["all"] + 1).otherwise(1).alias("all"), F.when(mine, a["steady"]).otherwise(closed(a)).alias("steady"))
    return F.aggregate(F.array_sort(F.col(judged)), start, step, closed)


def window_hits(texts: DataFrame, windows: DataFrame, broadcast_rows: int, salts: int) -> DataFrame:
    """(doc, key, at_item, diagonal) of every document window that is one of the benchmark's."""
    made = computed(texts, t=marked(F.col("text"), "all"))
    made = made.select("doc", template(cut(F.col("t"))).alias("temp"), literal(cut_plain(F.col("t"))).alias("words"))
    forms = [F.struct(F.lit(x).alias("literal"), F.col(c).alias("values")) for x, c in ((False, "temp"), (True, "words"))]
    forms = made.select("doc", F.explode_outer(F.array(*forms)).alias("f")).select("doc", "f.literal", "f.values")
    if windows.count() <= broadcast_rows:
        anchors = windows.select("literal", "anchor", "offset", "size").distinct()
        spots = forms.select("doc", "literal", "values", F.posexplode_outer("values").alias("pos", "anchor"))
        spots = spots.join(F.broadcast(anchors), ["literal", "anchor"]).withColumn("at_doc", F.col("pos") - F.col("offset"))
        spots = spots.where((F.col("at_doc") >= 0) & (F.col("at_doc") + F.col("size") <= F.size("values")))
        spots = spots.select("doc", "literal", "at_doc", window_hash(F.col("values"), F.col("at_doc"), F.col("size")).alias("hash"))
        met = spots.join(F.broadcast(windows.select("literal", "hash", "key", "at_item")), ["literal", "hash"])
    else:
        # in a lambda, element by element: the same hash as the slice's, which would copy the whole array for each window
        sizes = [r.size for r in windows.select("size").distinct().collect()]  # at most ``window`` numbers
        run_at = lambda n: lambda i: F.xxhash64(*[F.get(F.col("values"), i + k) for k in range(n)])
        hashes = [F.when(F.size("values") >= n, F.transform(F.sequence(F.lit(0), F.size("values") - n), run_at(n)))
                  .otherwise(F.array().cast("array<bigint>")) for n in sizes]
        spots = forms.select("doc", "literal", F.explode_outer(F.array(*hashes)).alias("w")).select("doc", "literal", F.posexplode_outer("w").alias("at_doc", "hash"))
        spots = spots.withColumn("salt", F.pmod(F.xxhash64("doc", "at_doc"), F.lit(salts)))
        salted = windows.select("literal", "hash", "key", "at_item", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
        met = spots.join(salted, ["literal", "hash", "salt"])
    return met.select("doc", "key", "at_item", (F.col("at_doc") - F.col("at_item")).alias("diagonal"))


def candidate_copies(hits: DataFrame, known: DataFrame, cover: float) -> DataFrame:
    """(doc, key, diagonal, cover, places) of every band of diagonals that covers enough of its item.

    ``known``: key, n_windows (those that can be found) and ``slack``, half the item's length.
    """
    hits = hits.groupBy("doc", "key", "diagonal", "at_item").agg(F.lit(1).alias("one"))
    hits = hits.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc", "key", "diagonal"))).join(known, "key")
    band = F.floor(F.col("diagonal") / F.col("slack"))
    hits = hits.withColumn("band", F.explode(F.array(band, band - 1)))
    best = hits.groupBy("doc", "key", "band", "at_item", "n_windows").agg(F.max(F.struct("n", (-F.col("diagonal")).alias("left"))).alias("best"))
    bands = best.groupBy("doc", "key", "band", "n_windows").agg(
        F.count(F.lit(1)).alias("found"), F.max("best").alias("main"), F.array_sort(F.collect_list(F.struct("at_item", (-F.col("best.left")).alias("diagonal")))).alias("places"))
    bands = bands.where(F.col("found") >= cover * F.col("n_windows"))
    copies = bands.select("doc", "key", (-F.col("main.left")).alias("diagonal"), (F.col("found") / F.col("n_windows")).alias("cover"), "places")
    # both bands of a diagonal may name the same copy: the fuller one stays
    return copies.groupBy("doc", "key", "diagonal").agg(F.max(F.struct("cover", "places")).alias("c")).select("doc", "key", "diagonal", "c.cover", "c.places")


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text", window: int = 8, shortest: int = 4, cover: float = 0.5, evidence: float = 5.0,
               broadcast_rows: int = 2_000_000, salts: int = 8) -> DataFrame:
    """(doc_id, item_id, cover, agree, n_slots, kind) of every contaminated pair."""
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    items = store(benchmark_items(benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")), window, shortest), "leak-items")
    items = store(with_weights(items, word_weights(texts, items)), "leak-weights")
    windows = store(benchmark_windows(items), "leak-windows")
    slack = F.greatest(F.lit(1), F.floor(F.col("n_tokens") / 2)).cast("int").alias("slack")
    known = items.select("key", slack).join(windows.groupBy("key").agg(F.count(F.lit(1)).alias("n_windows")), "key")
    copies = store(candidate_copies(window_hits(texts, windows, broadcast_rows, salts), known, cover), "leak-copies")

    # the few documents concerned once more: each copy takes the tokens around it
    again = texts.join(copies.select("doc").distinct(), "doc", "left_semi").distinct()
    again = computed(again, t=marked(F.col("text"), "all")).select("doc", cut(F.col("t")).alias("d_toks"), cut_plain(F.col("t")).alias("d_words"))
    pairs = copies.join(items.withColumn("slack", slack), "key").withColumn("low", F.greatest(F.lit(0), F.col("diagonal") - F.col("slack")))
    length = F.col("diagonal") + F.col("n_tokens") + F.col("slack") - F.col("low")
    around = lambda toks: F.slice(F.col(toks), F.col("low") + 1, length)
    both = again.join(pairs, "doc").select(*pairs.columns, F.when(F.col("form") == LITERAL, around("d_words")).otherwise(around("d_toks")).alias("d_toks"))
    both = align(both)
    agree = F.size("same") / F.col("n_tokens")
    unchanged = F.size(F.filter("slots", lambda s: s["mine"] == s["theirs"]))
    as_is = (F.col("n_equal") >= cover * F.col("n_tokens")) & (unchanged >= cover * F.size("slots"))
    found = both.where((agree >= cover) & ((F.col("form") == LITERAL) | ((F.col("weight") >= evidence) & (as_is | one_value_each("judged")))))
    kind = F.when(unchanged < F.size("slots"), "re-parameterised").when(agree >= 0.9, "verbatim").otherwise("partial")
    # of a pair's copies the closest names the kind: verbatim, then re-parameterised, then partial
    return found.select("doc", "item", "cover", agree.alias("agree"), F.size("slots").alias("n_slots"), kind.alias("kind")).groupBy("doc", "item").agg(
        F.max("cover").alias("cover"), F.max("agree").alias("agree"), F.max("n_slots").cast("long").alias("n_slots"), F.max("kind").alias("kind")
    ).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "cover", "agree", "n_slots", "kind")


def keep_rows(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that leak no benchmark item, with all their columns."""
    leaks = store(find_leaks(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias("__id")).distinct(), "leaking")
    return docs.join(leaks, docs[id_col] == leaks["__id"], "left_anti")
