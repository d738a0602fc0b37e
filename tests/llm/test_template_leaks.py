"""op1: planted leaks, re-parameterised questions, slots, edge cases."""

import re

from fleetscope.llm.q_template_leaks import op1_template_leaks
from fleetscope.llm.template_leaks import UNITS, find_leaks, template, tokens

SF = "/root/testdata/sf0.01"


def plain(text):
    return " " + " ".join(re.findall(r"[^\W_]+", (text or "").lower())) + " "


def test_whole_table_against_brute_force(spark):
    docs = {r.doc_id: plain(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r.item_id: plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = {(d, i) for d, t in docs.items() for i, b in items.items() if b in t}
    got = {(r.doc_id, r.item_id) for r in op1_template_leaks(spark, SF).collect()}
    assert want and want <= got
    for d, i in got - want:  # what else is reported shares half of the item's words in order
        words = items[i].split()
        runs = [" " + " ".join(words[k:k + 6]) + " " in docs[d] for k in range(max(1, len(words) - 5))]
        assert sum(runs) >= 0.4 * len(runs)


def test_no_python_in_the_plan(spark):
    plan = op1_template_leaks(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


QUESTION = "Yesterday morning Maria bought 14 kg of apples at 3.50 dollars each and then Maria sold 14 of them to Peter for 80 dollars in total"
CHANGED = "Yesterday morning Helga bought 25 lb of apples at 7.25 euros each and then Helga sold 25 of them to Bruno for 90 euros in total"
UNFAITHFUL = "Yesterday morning Helga bought 25 lb of apples at 7.25 euros each and then Bruno sold 31 of them to Bruno for 31 euros in total"


def test_reparameterised_questions_and_edge_cases(spark):
    rows = [(1, f"Some text before. {CHANGED} and after", 0), (2, f"Some text before. {UNFAITHFUL}", 0), (3, QUESTION, 0), (4, None, 0), (5, "", 0),
            (6, "filler words here and there " * 20_000 + QUESTION, 0), (7, "apples and pears are sold each morning in the market of the town", 0),
            (8, "he said five little ducks today", 0), (1, f"Some text before. {CHANGED} and after", 0), (None, QUESTION, 0),
            (9, QUESTION.replace(" ", " *** "), 0), (10, "short one", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item int")
    items = spark.createDataFrame([(1, QUESTION), (2, "five little ducks"), (3, "five little ducks today"), (4, None), (5, ""), (6, QUESTION), (None, QUESTION)],
                                  "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in find_leaks(docs, items).collect()}
    assert set(got) == {(d, i) for d in (1, 3, 6, 9) for i in (1, 6)} | {(8, 3)}
    assert got[1, 1].kind == "re-parameterised" and got[3, 1].kind == "verbatim" and got[1, 1].n_slots >= 7
    wide = {(r.doc_id, r.item_id) for r in find_leaks(docs, items, broadcast_rows=0).collect()}
    assert wide == set(got)
    assert find_leaks(docs.limit(0), items).count() == 0 and find_leaks(docs, items.limit(0)).count() == 0


def test_tokens_and_slots(spark):
    df = spark.createDataFrame([("In 1999 Anna paid 3,500 kg. Then 5kg of Anna's",)], "t string")
    toks = df.select(tokens(df.t).alias("k"))
    assert toks.first().k == ["in", "1999", "\u0001anna", "paid", "3500", "\u0002kg", "then", "5", "\u0002kg", "of", "\u0001anna", "s"]
    kinds = toks.select(template(toks.k).alias("x")).first().x
    assert kinds[1] == kinds[4] == kinds[7] == -1 and kinds[5] == kinds[8] == -3 and kinds[2] == kinds[10] == -2


WORDS = [f"{a}{b}" for a in ("ba", "de", "fi", "go", "lu", "ma", "ne", "po", "ri", "su") for b in ("lt", "nd", "rk", "st", "mp", "sk")][:59]
LONG = " ".join(WORDS)


def leaks_of(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {(r.doc_id, r.item_id): r for r in find_leaks(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}


def test_every_copy_and_its_neighbouring_diagonals(spark):
    def inserted(*at):
        return " ".join(w + (" quux" if k in at else "") for k, w in enumerate(WORDS))

    got = leaks_of(spark, [f"{UNFAITHFUL}. Then some more drills follow here. {QUESTION}", inserted(18, 38), inserted(14, 28, 43),
                           " ".join(w for k, w in enumerate(WORDS) if k != 29), " ".join(reversed(WORDS))], [QUESTION, LONG])
    assert set(got) == {(0, 0), (1, 1), (2, 1), (3, 1)}
    assert got[0, 0].kind == "verbatim" and got[1, 1].agree == 1 and got[2, 1].agree == 1 and got[3, 1].agree > 0.9


def test_slots_map_by_majority(spark):
    short = "they bought 14 big boxes then sold 14 of them"
    merged = CHANGED.replace("90", "25")  # 14 and 80 both become 25
    got = leaks_of(spark, [QUESTION.replace("sold 14", "sold 15"), merged, UNFAITHFUL, short.replace("sold 14", "sold 15")], [QUESTION, short])
    assert set(got) == {(0, 0), (1, 0), (3, 1)} and got[1, 0].kind == "re-parameterised"


def test_names_of_two_words_openers_context_and_case(spark):
    two = QUESTION.replace("Maria", "Anna Lena").replace("Peter", "Jean Paul")
    opens = "Maria had 14 red apples. Maria ate 3 of them. Peter found 5 more. Peter gave 2 to us."
    other = "Helga had 25 red apples. Helga ate 7 of them. Bruno found 9 more. Bruno gave 4 to us."
    brief = "Which river is longest here"
    got = leaks_of(spark, [two, other, f"Question three\n{brief}\nmore text", QUESTION.lower(), f"and {CHANGED[0].lower()}{CHANGED[1:]}", "1 500 apples"],
                   [QUESTION, opens, brief])
    assert set(got) == {(0, 0), (1, 1), (2, 2), (3, 0), (4, 0)}
    assert got[0, 0].kind == got[1, 1].kind == "re-parameterised" and got[3, 0].kind == "verbatim"


def test_clean_documents_are_left_alone(spark):
    items = ["Paris is in France", "5 kg 3 lb", "Einstein was born on 14 March 1879 in Ulm", "3 km 4 kg 5 m 6 s 7 kg 8 lb 9 cm 10 km 11 m"]
    texts = ["Tom is in London", "mix 3 kg 9 lb 2 oz of it", "Maria was born on 3 April 1990 in Rome", "Tom is in France", "take 1 km 2 kg 3 m 4 s 5 kg 6 lb 7 cm 8 km 9 m"]
    assert leaks_of(spark, texts, items) == {}
    assert set(leaks_of(spark, ["so, paris is in france.", "a 5 kg 3 lb b", "EINSTEIN WAS BORN on 14 March 1879 in Ulm!"], items)) == {(0, 0), (1, 1), (2, 2)}


def test_edge_slots_are_judged_unless_their_run_goes_on(spark):
    body = "walked along the quiet river bank towards an old wooden bridge where"
    item = f"{body} Maria met Peter"
    changed = f"{body.replace('quiet', 'noisy')} Helga met Bruno"
    got = leaks_of(spark, [changed, f"{changed} Schmidt"], [item])
    assert set(got) == {(0, 0), (1, 0)}
    repeated = f"Peter {body} Maria met Peter"
    # Peter would stand for Bruno and for Karl: no majority
    assert set(leaks_of(spark, [f"Karl {body} Helga met Bruno".replace("quiet", "noisy")], [repeated])) == set()


def test_a_repetitive_document_in_bounded_rows(spark):
    once = "the price of {} kg is {} euros today and "
    drill = "".join(once.format(k % 7, k) for k in range(40))
    pairs = "; ".join(["5 kg 3 km"] * 40)
    texts = ["".join(once.format(k, k % 9) for k in range(600)), "; ".join(["5 kg 3 km"] * 600), "; ".join(["6 kg 4 km"] * 600), "x " + drill + " y"]
    got = leaks_of(spark, texts, [drill, pairs])
    assert (3, 0) in got and got[3, 0].kind == "verbatim" and (1, 1) in got and (2, 1) not in got


def test_openers_after_many_separators(spark):
    item = "- - - * * * # # # > > > Maria had 14 red apples and gave them all to us, then she went home"
    assert set(leaks_of(spark, ["Yes, maria had 15 red apples and gave them all to us, then she went home", "nothing"], [item])) == {(0, 0)}


def test_wide_benchmarks_find_the_same(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(find_leaks(docs, items)) == rows(find_leaks(docs, items, broadcast_rows=0))


def marks(text, names):
    """Token list of (literal, kind) by a plain walk; kind is word, number, name or unit."""
    import regex
    t = regex.sub(r"[^\p{L}\p{N}.,;:!?]+", " ", text or "")
    t = regex.sub(r"(?<=[0-9])[.,](?=[0-9])", "", t)
    t = regex.sub(r"(?<=[0-9])(?=\p{L})", " ", t)
    out = []
    for m in regex.finditer(r"[\p{L}\p{N}]+", t):
        w, before = m.group(), t[:m.start()]
        kind = "number" if w[0] in "0123456789" else "word"
        if names != "none":
            if regex.match(r"\p{Lu}\p{Ll}", w) and not (names == "but first" and not out):
                kind = "name"
            unit = regex.match(f"(?i:{'|'.join(UNITS.split())})(?!\\p{{L}})", w)
            if unit and len(before) > 1 and before[-2] in "0123456789" and before[-1] == " " and kind != "name":
                kind = "unit"
        if out and names != "none" and kind == out[-1][1] and kind in ("name", "number") and (kind == "name" or w.isdigit() and w.isascii()):
            out[-1] = (out[-1][0] + (w.lower(),), kind)
        else:
            out.append(((w.lower(),), kind))
    return out


def brute_leaks(docs, items, window=8, shortest=4, cover=0.5, evidence=5.0):
    """The rule of the module in plain Python."""
    import math
    from collections import Counter
    simple = [set(re.split(r"[\W_]+", (t or "").lower())) for t in docs.values()]
    df = Counter(w for s in simple for w in s)
    weight = lambda w: max(0.0, min(1.0, -math.log10((df[w] + 1) / (len(docs) + 1000)) / 2)) if df[w] else 1.0
    found = set()
    for form in ("all", "but first", "none"):
        shape = lambda toks: [("slot", k) if form != "none" and k != "word" else ("word", w) for w, k in toks]  # noqa: E731,B023
        seen = {d: marks(t, "none" if form == "none" else "all") for d, t in docs.items()}
        for i, text in items.items():
            mine = marks(text, form)
            n = len(mine)
            if n < shortest:
                continue
            s, size, slack = shape(mine), min(n, window), max(1, n // 2)
            usable = {k: tuple(s[k:k + size]) for k in range(n - size + 1) if any(x[0] == "word" for x in s[k:k + size])}
            at = {}
            for k, w in usable.items():
                at.setdefault(w, []).append(k)
            for d, toks in seen.items():
                t = shape(toks)
                hits = {}
                for j in range(len(t) - size + 1):
                    for k in at.get(tuple(t[j:j + size]), ()):
                        hits.setdefault(j - k, set()).add(k)
                for b in {x // slack - e for x in hits for e in (0, 1)}:
                    diagonals = [x for x in hits if b <= x // slack <= b + 1]
                    places = {}
                    for x in diagonals:
                        for k in hits[x]:
                            places[k] = max(places.get(k, (0, 0)), (len(hits[x]), -x))
                    if len(places) < cover * len(usable):
                        continue
                    main = -max(places.values())[1]
                    same = []
                    for k in range(n):
                        near = [j for j in range(max(0, k - size + 1), k + 1) if j in places]
                        far = k + (-places[near[-1]][1] if near else main)
                        if max(0, main - slack) <= far < min(len(t), main + n + slack) and t[far] == s[k]:
                            same.append((k, far))
                    slots = [(mine[k], toks[far], k in (0, n - 1)) for k, far in same if s[k][0] == "slot"]
                    equal = sum(mine[k][0] == toks[far][0] for k, far in same)
                    unchanged = sum(a[0] == b[0] for a, b, _ in slots)
                    words = sum(weight(mine[k][0][0]) for k, _ in same if s[k][0] == "word")
                    judged = [(a, b) for a, b, edge in slots if not (edge and len(b[0]) > len(a[0]))]
                    steady = all(max(Counter(b for x, b in judged if x == a).values()) * 2 > sum(x == a for x, _ in judged) for a, _ in judged)
                    as_is = equal >= cover * n and unchanged >= cover * len(slots)
                    if len(same) >= cover * n and (form == "none" or (words >= evidence and (as_is or steady))):
                        found.add((d, i))
    return found


def test_pair_by_pair_against_the_rule_in_plain_python(spark):
    small = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    extra = [QUESTION, CHANGED, UNFAITHFUL, QUESTION.lower(), "Maria was born on 3 April 1990 in Rome", "x 5 kg 3 km; 5 kg 3 km; 5 kg 3 km " * 6,
             "Then they bought 14 big boxes and then sold 15 of them", LONG.replace(WORDS[20], "quux " + WORDS[20])]
    docs |= {10_000 + k: t for k, t in enumerate(extra)}
    items |= {20_000 + k: t for k, t in enumerate([QUESTION, LONG, "Einstein was born on 14 March 1879 in Ulm", "5 kg 3 km; 5 kg 3 km", "they bought 14 big boxes and then sold 14 of them"])}
    as_df = lambda d, c: spark.createDataFrame(list(d.items()), f"{c} long, text string")
    got = {(r.doc_id, r.item_id) for r in find_leaks(as_df(docs, "doc_id"), as_df(items, "item_id")).collect()}
    assert got == brute_leaks(docs, items) and len(got) > 5


def test_marks_start_with_a_character(spark):
    """A pattern that starts with a look behind is tried at every place of a text; the marks stay the same."""
    from pyspark.sql import functions as F
    from fleetscope.llm.template_leaks import marked
    df = spark.createDataFrame([("In 1,234.5 kg and 5Kg, Bob met 3 4 x7y, 12 min.",)], "text string")
    out = df.select(marked(F.col("text"), "all").alias("t"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert ", (?<=" not in plan and ", (?<![\\p{L}\\p{N}])([0-9]+)" not in plan
    assert out.first().t == "\u0001In 12345 \u0002kg and 5 \u0001Kg\u0003\u0001Bob met 3\u00034 x7 y, 12 \u0002min."
