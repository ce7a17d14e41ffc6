"""Linking the spellings of a name typed by people.

A name is reduced to a signature: its words without accents, titles, legal forms, notes in brackets and contact persons,
in alphabetical order. Names with one signature are one entity, so everything after works on distinct signatures.

Words are mended first: a rare word within one edit of a much commoner one, or an abbreviation of exactly one commoner
word, becomes that word. Common words are those on at least one in ``COMMON`` signatures, so there are at most
COMMON * (words per name) of them; only that bounded list is broadcast.

Candidates come from a symmetric-delete index over the distinct words: words that share a deletion variant (up to two
letters), or of which one is the other typed without vowels, are near if ``word_cost`` says so. A signature's keys are
its words, and its words with one exchanged for a near word; two signatures that differ in two words meet where each has
taken one of the other's. Names of three and more words also have keys with two words exchanged, for one edit in each of
three words. That is all the alignment can accept, and no key gathers names for sharing a common word. Names typed
without spaces have a key of their own. Every candidate pair is verified by the optimal assignment of its words
(``align``), and the verified pairs' connected components are the firm groups.

Weak evidence then links a group to another only where that other is the only candidate: initials, truncated words,
nicknames, and a dropped common word. A group without any such candidate is asked again with up to two of its other words
misspelt: candidates meet in keys of exchanged words and are verified by the assignment that permits initials,
truncations and nicknames (``align`` with short words), and again exactly one group must fit.

Edge cases: words of any length match within their edits, truncations of up to ``PREFIX`` letters; null and blank names have
no group; a name of titles and legal forms only keeps its own text as its word;
a name that nothing resembles is a group of its own; repeated names count once; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.graph import components
from ledgerloom.runtime import materialize, scratch

# --- fixed values: words of names ------------------------------------------------------------------------------------
ACCENTS = ("áàâäãåāéèêëēíìîïīóòôöõōúùûüūçñýÿ", "aaaaaaaeeeeeiiiiioooooouuuuucnyy")
TITLES = "arch|ing|haji|sayed|site|office|mr|mrs|ms|miss|mister|dr|eng|engr|prof|capt|sheikh|messrs|m s|the|and|attn|mob|mobile|tel|c o"
LEGAL = "llc|l l c|fze|fzc|fzco|fz llc|fzllc|fz|ltd|limited|inc|co|company|corp|corporation|est|establishment|pjsc|plc|wll|spc"
ABBREVIATIONS = {"intl": "international", "int": "interiors", "ads": "advertising", "adv": "advertising", "advt": "advertising", "mgmt": "management", "mgt": "management", "wks": "works", "svcs": "services", "serv": "services", "svc": "services", "tech": "technical", "hosp": "hospitality", "grp": "group", "contg": "contracting", "contr": "contracting", "nursery": "nurseries", "sch": "school", "ent": "entertainment", "dec": "decoration", "decor": "decoration", "prod": "productions", "exh": "exhibitions", "exhib": "exhibitions", "ev": "events", "evts": "events", "tdg": "trading", "tr": "trading", "intr": "interiors", "rtl": "retail", "jnry": "joinery", "nurs": "nurseries", "arahman": "abdulrahman", "cont": "contracting", "sm": "sportsmanagement", "ts": "technicalservices", "jw": "joineryworks", "hg": "hospitalitygroup", "is": "internationalschool", "trdg": "trading", "mohd": "mohammed", "md": "mohammed", "muhammad": "mohammed", "mohamed": "mohammed", "mohammad": "mohammed", "mohamad": "mohammed"}
COMPOUNDS = "international school|joinery works|technical services|sports management|hospitality group|general trading|abdul rahman|abdur rahman|abdel rahman|a rahman"
NICKNAMES = {
    "abdulrahman": "abdul|abed", "alexander": "alex|alec|sandy|xander|lex", "benjamin": "ben|benny|benji", "catherine": "kate|cathy|cath|katie", "charles": "charlie|chuck", "christina": "chris|tina|chrissy|christy", "christopher": "chris|kit|topher", "daniel": "dan|danny", "david": "dave|davy",
    "deborah": "deb|debbie|debby", "edward": "ed|eddie|ted|ned|teddy", "elizabeth": "liz|beth|lizzie|betty|eliza|libby|betsy", "fatima": "fati|fatma", "frederick": "fred|freddie", "gregory": "greg|gregg", "hussain": "hussein|husain", "ignatius": "iggy|ignaz|nate", "james": "jim|jimmy|jamie", "jennifer": "jen|jenny|jenn", "john": "jack|johnny|jon", "jonathan": "jon|jonny",
    "joseph": "joe|joey", "katherine": "kate|kathy|katie|kat|kitty|kathie", "lawrence": "larry|laurie|lars", "margaret": "meg|maggie|peggy", "matthew": "matt", "michael": "mike|mick|mikey|micky", "nicholas": "nick|nicky|nico", "olivia": "liv|livvy|ollie", "patricia": "pat|patty|tricia", "patrick": "pat|paddy", "penelope": "penny|pen|nell", "peter": "pete", "rebecca": "becky|becca",
    "richard": "rick|dick|rich|ricky|richie", "robert": "bob|rob|bobby|robbie|bert", "samuel": "sam|sammy", "samantha": "sam|sammy", "stephen": "steve|stevie", "susan": "sue|susie", "theodore": "ted|theo|teddy", "thomas": "tom|tommy", "timothy": "tim|timmy", "ursula": "ursa|uschi|ulla", "victoria": "vicky|vicki|tori", "william": "bill|will|billy|willy|liam", "yousef": "youssef|joe|yusuf|yousuf", "zachary": "zach|zack|zak",
}
# ----------------------------------------------------------------------------------------------------------------------
COMMON = 400
LINKED = 0.75  # the cost up to which an alignment links two names
WEAK_ROUNDS = 2  # the second sees what the first has joined: "T." fits Tom and Thomas, who are one by then
PREFIX = 64  # letters that a truncation may leave
RARER = 4  # a word is mended only into one this many times as common


def words_of(name: Column) -> Column:
    s = F.translate(F.lower(name), *ACCENTS)
    s = F.regexp_replace(s, r"[\(\[][^\)\]]*[\)\]]?", " ")
    s = F.regexp_replace(s, r"\s/.*$|\battn\b.*$", " ")
    s = F.regexp_replace(s, r"\bm/s\b", " ")
    s = F.regexp_replace(s, r"\bc/o\b.*$", " ")
    s = F.regexp_replace(s, r"[.'’`]", "")
    s = F.concat(F.lit(" "), F.trim(F.regexp_replace(s, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    bare = F.trim(s)
    s = F.replace(s, F.lit(" "), F.lit("  "))
    s = F.regexp_replace(s, rf" ({LEGAL.replace(' ', '  ')}) ", " ")
    s = F.regexp_replace(s, rf" ({TITLES.replace(' ', '  ')}) ", " ")
    s = F.trim(F.regexp_replace(s, " +", " "))
    return F.split(F.when(s != "", s).when(bare != "", bare).otherwise(F.trim(F.lower(name))), " ")


def one_less(w: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))


def deletions(word: Column) -> Column:
    """The word and what is left of it without one letter, or without two where it has seven or more.

    Two letters go from words of up to 24 letters, one from words of up to 64; longer ones have too many variants, and
    meet by segments (long_segments)."""
    one = one_less(word)
    two = F.flatten(F.transform(one, one_less))
    return F.array_distinct(F.when(~F.length(word).between(4, 64), F.array(word)).when(~F.length(word).between(7, 24), F.array_append(one, word)).otherwise(F.array_append(F.concat(one, two), word)))


LONG = 22  # letters beyond which two edits are found by segments: two under what deletions() takes whole


def _segment(n: Column, i: Column) -> tuple[Column, Column]:
    """Where segment i of five of a word of n letters begins, and its length."""
    start = F.floor(n * i / 5).cast("int")
    return start + 1, F.floor(n * (i + 1) / 5).cast("int") - start


def long_segments(word: Column) -> Column:
    """The five segments of a word, each with its number and the word's length. Two edits, of which a swap of neighbours may
    spoil two segments, leave one of them whole."""

    def key(i: Column) -> Column:
        start, n = _segment(F.length(word), i)
        return F.concat_ws(":", F.length(word), i, F.substring(word, start, n))

    return F.transform(F.sequence(F.lit(0), F.lit(4)), key)


def long_probes(word: Column) -> Column:
    """What long_segments of a word within two edits may hold: the texts at the places that two edits can reach."""
    reach = F.sequence(F.lit(-2), F.lit(2))

    def key(change: Column, i: Column, shift: Column) -> Column:
        start, n = _segment(F.length(word) + change, i)
        return F.concat_ws(":", F.length(word) + change, i, F.substring(word, F.greatest(start + shift, F.lit(1)), n))

    return F.array_distinct(F.flatten(F.transform(reach, lambda c: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.transform(reach, lambda s: key(c, i, s)))))))


def bones(word: Column) -> Column:
    """The word without the vowels inside it."""
    return F.concat(F.left(word, F.lit(1)), F.translate(F.substring(word, F.lit(2), F.greatest(F.length(word) - 2, F.lit(0))), "aeiou", ""), F.when(F.length(word) > 1, F.right(word, F.lit(1))).otherwise(""))


def distance(a: str, b: str, most: int) -> int:
    """Edits of one letter, swaps of neighbours counting one; most + 1 where there are more than most."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        before, row = row, new
    return min(row[-1], most + 1)


def word_cost(a: str, b: str) -> float:
    """0 for equal words, up to 1 for the same word misspelt, more than 1 where they can't be one word."""
    if a == b:
        return 0.0
    short, long = sorted((a, b), key=len)
    most = 0 if len(short) < 4 else 1 if len(short) < 7 else 2
    d = distance(a, b, most) if most else most + 1
    if most and d <= most:
        return 0.25 * d
    vowels = str.maketrans("", "", "aeiou")
    if len(short) > 2 and short == long[0] + long[1:-1].translate(vowels) + long[-1]:
        return 0.4
    return 9.0


def short_cost(a: str, b: str) -> float:
    """word_cost, and 0.25 where one word is the other's initial, beginning (of three letters or more) or nickname."""
    short, long = sorted((a, b), key=len)
    cut = short != long and (len(short) == 1 or len(short) > 2) and long.startswith(short)
    return min(word_cost(a, b), 0.25 if cut or a in NICKNAMES.get(b, "").split("|") or b in NICKNAMES.get(a, "").split("|") else 9.0)


def align(a: list[str], b: list[str], cost=word_cost) -> float:
    """Cost of the best assignment of the words of two names of equally many; names run together cost 0.1."""
    a, b = list(a), list(b)
    if len(a) != len(b):
        return 9.0
    for w in set(a) & set(b):  # equal words belong together: what is left is small
        for _ in range(min(a.count(w), b.count(w))):
            a.remove(w)
            b.remove(w)
    costs = [[cost(x, y) for y in b] for x in a]
    return min(9.0, assignment(costs)) if costs else 0.0


def assignment(costs: list[list[float]]) -> float:
    """Least sum of a square table with one entry of every row and column: a row at a time, by the shortest path that
    makes room for it, under potentials that keep all reduced costs from falling below zero."""
    n = len(costs)
    rows, columns, taken = [0.0] * n, [0.0] * (n + 1), [-1] * (n + 1)
    for i in range(n):
        taken[n] = i
        at, far, back, done = n, [float("inf")] * n, [n] * n, [False] * (n + 1)
        while taken[at] >= 0:
            done[at] = True
            row = taken[at]
            for j in range(n):
                d = costs[row][j] - rows[row] - columns[j]
                if not done[j] and d < far[j]:
                    far[j], back[j] = d, at
            nearest = min((j for j in range(n) if not done[j]), key=lambda j: far[j])
            step = far[nearest]
            for j in range(n + 1):
                if done[j]:
                    rows[taken[j]] += step
                    columns[j] -= step
                elif j < n:
                    far[j] -= step
            at = nearest
        while at < n:
            taken[at] = taken[back[at]]
            at = back[at]
    return sum(costs[taken[j]][j] for j in range(n))


def word_costs(a: str, b: str) -> Column:
    @F.pandas_udf("double")
    def cost(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([word_cost(x, y) for x, y in zip(left, right)], dtype="float64")

    return cost(a, b)


def alignment(a: str, b: str, by=word_cost) -> Column:
    @F.pandas_udf("double")
    def cost(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([align(x, y, by) for x, y in zip(left, right)], dtype="float64")

    return cost(a, b)


def mended(words: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """(word -> better word, common words with their counts) from rows (word, n) and the number of signatures."""
    common = materialize(words.filter((F.col("n") * COMMON >= total) & (F.col("n") >= 5) & (F.length("word") > 3)).select(F.col("word").alias("full"), F.col("n").alias("many")), "name-common")
    rare = words.select("word", "n").filter(F.length("word") > 1)
    # Both sides of these joins are broadcast on purpose: `common` is bounded by COMMON.
    typo = (
        rare.filter("length(word) > 4").withColumn("v", F.explode(deletions(F.col("word"))))
        .join(F.broadcast(common.withColumn("v", F.explode(deletions(F.col("full"))))), "v")
        .filter((F.col("word") != F.col("full")) & (F.col("n") * RARER <= F.col("many")))
        .select("word", "full", "many", F.levenshtein("word", "full").alias("d"), F.length("word").alias("len"))
        .filter("d <= case when len < 8 then 1 else 2 end")
    )
    typo = typo.groupBy("word").agg(F.min_by("full", F.struct("d", -F.col("many"), "full")).alias("full"))
    short = (
        rare.filter("length(word) between 2 and 8 and word rlike '^[a-z]+$'").withColumn("v", F.left("word", F.lit(1)))
        .join(F.broadcast(common.withColumn("v", F.left("full", F.lit(1)))), "v")
        .filter((F.col("n") * RARER <= F.col("many")) & (F.length("word") + 2 <= F.length("full")) & F.expr("full rlike concat('^', regexp_replace(word, '(.)', '$1.*'))"))
    )
    short = short.groupBy("word").agg(F.count("*").alias("k"), F.min("full").alias("full")).filter("k = 1").select("word", "full")
    both = typo.withColumn("p", F.lit(0)).unionByName(short.withColumn("p", F.lit(1)))
    return both.groupBy("word").agg(F.min_by("full", "p").alias("full")), common


def signatures(names: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(name -> sig, sig -> words, common words) for rows (kind, name)."""
    lexicon = F.create_map(*(F.lit(x) for kv in ABBREVIATIONS.items() for x in kv))
    raw = names.filter("kind is not null and trim(name) <> ''").select("kind", "name").distinct().withColumn("seq", words_of(F.col("name")))
    raw = raw.withColumn("seq", F.transform("seq", lambda w: F.coalesce(F.try_element_at(lexicon, w), w)))
    joined = F.array_join("seq", " ")
    for pair in COMPOUNDS.split("|"):
        joined = F.regexp_replace(joined, rf"\b{pair}\b", pair.replace(" ", ""))
    raw = raw.withColumn("seq", F.transform(F.split(joined, " "), lambda w: F.coalesce(F.try_element_at(lexicon, w), w)))
    # a middle initial beside two full words tells nothing
    full = F.filter("seq", lambda w: F.length(w) > 1)
    raw = materialize(raw.withColumn("seq", F.when(F.size(full) > 1, full).otherwise(F.col("seq"))), "name-raw")
    sets = raw.select("kind", F.array_sort("seq").alias("w")).distinct()
    counted = sets.select(F.explode(F.array_distinct("w")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    fix, common = mended(materialize(counted, "name-words"), sets.count())
    single = raw.select("kind", "name", F.posexplode("seq").alias("p", "word")).join(fix, "word", "left")
    whole = single.groupBy("kind", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", F.coalesce("full", "word").alias("w")))), lambda x: x["w"]).alias("seq"))
    named = whole.withColumn("words", F.array_sort("seq")).select("kind", "name", "words", F.array_join("seq", "").alias("run"), F.xxhash64("kind", "words").alias("sig"))
    named = materialize(named, "name-signed")
    sigs = materialize(named.groupBy("sig").agg(F.first("kind").alias("kind"), F.first("words").alias("words"), F.collect_set("run").alias("runs")), "name-sigs")
    return named.select("kind", "name", "sig"), sigs, common


def _keys(sigs: DataFrame, tag: str, of) -> DataFrame:
    """sig, key: for each word of a signature, the keys of(word) each with the other words."""
    each = sigs.filter("size(words) > 1").select("sig", "kind", "words", F.posexplode("words").alias("p", "word")).withColumn("rest", F.array_join(F.filter("words", lambda w, i: i != F.col("p")), " "))
    return each.select("sig", "kind", "rest", F.explode(of(F.col("word"))).alias("v")).select("sig", F.xxhash64(F.lit(tag), "kind", "rest", "v").alias("key")).distinct()


def near_words(sigs: DataFrame) -> DataFrame:
    """word, other, cost, both ways: different words of the signatures that can be one word misspelt."""
    words = materialize(sigs.select(F.explode("words").alias("word")).distinct(), "name-vocabulary")
    keyed = materialize(words.filter("length(word) > 3").select("word", F.explode(deletions(F.col("word"))).alias("v")), "name-variants")
    typos = keyed.alias("x").join(keyed.alias("y"), F.expr("x.v = y.v and x.word < y.word")).select(F.col("x.word").alias("a"), F.col("y.word").alias("b"))
    boned = words.filter("length(word) > 2").select(F.col("word").alias("full"), bones(F.col("word")).alias("word")).join(words, "word").filter("word <> full and length(word) > 2")
    long = words.filter(f"length(word) > {LONG}")
    met = long.select("word", F.explode(long_probes(F.col("word"))).alias("v")).join(long.select(F.col("word").alias("full"), F.explode(long_segments(F.col("word"))).alias("v")), "v").filter("word < full and levenshtein(word, full, 4) between 1 and 4")
    typos = typos.union(met.select("word", "full"))
    pairs = typos.union(boned.select(F.least("word", "full"), F.greatest("word", "full"))).distinct()
    pairs = materialize(pairs.withColumn("cost", word_costs("a", "b")).filter(F.col("cost") <= LINKED), "name-near")
    return pairs.union(pairs.select("b", "a", "cost")).toDF("word", "other", "cost")


def respelled(sigs: DataFrame, near: DataFrame, after: str = "-1") -> DataFrame:
    """sig, kind, words, p: the signatures with one word, at p > after, exchanged for a near one; words keep their places."""
    each = sigs.select("sig", "kind", "words", F.expr(after).alias("at"), F.posexplode("words").alias("p", "word")).filter("p > at").join(near.select("word", "other"), "word")
    return each.select("sig", "kind", F.transform("words", lambda w, i: F.when(i == F.col("p"), F.col("other")).otherwise(w)).alias("words"), "p")


def firm_edges(sigs: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """a, b: pairs of signatures that the alignment takes for one name."""
    near = near_words(sigs) if near is None else near
    run = sigs.select("sig", "kind", F.explode("runs").alias("v")).select("sig", F.xxhash64(F.lit("run"), "kind", "v").alias("key"))
    known = sigs.filter("size(words) > 1 or length(words[0]) > 6").select("sig", "kind", "words")
    one = materialize(respelled(known, near), "name-one")
    # three words with an edit each: two are exchanged here, the third in the other name
    slight = near.filter(F.col("cost") <= LINKED / 3)
    two = respelled(respelled(known.filter("size(words) > 2"), slight), slight, "p")
    key = ("sig", F.xxhash64("kind", F.array_sort("words")).alias("key"))
    once = one.select(*key).distinct()
    keys = materialize(known.select(*key).union(once), "name-keys")

    def meet(k: DataFrame, other: DataFrame) -> DataFrame:
        return k.alias("x").join(other.alias("y"), F.expr("x.key = y.key and x.sig <> y.sig")).select(F.least("x.sig", "y.sig").alias("a"), F.greatest("x.sig", "y.sig").alias("b")).distinct()

    words = sigs.select("sig", "words")
    pairs = meet(keys, keys).union(meet(two.select(*key).distinct(), once)).distinct().join(words.toDF("a", "wa"), "a").join(words.toDF("b", "wb"), "b")
    return pairs.filter(alignment("wa", "wb") <= LINKED).select("a", "b").union(meet(run, run))


def nickname_map() -> Column:
    nick: dict[str, list[str]] = {}
    for full, shorts in NICKNAMES.items():
        for s in shorts.split("|"):
            nick.setdefault(s, []).append(full)
    return F.create_map(*(x for k, v in nick.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))


def short_keys(sigs: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """sig, key of names with an initial, a truncation or a nickname, and of the names that these can mean."""
    nicknames = nickname_map()
    prefixes = lambda w: F.when(F.length(w) > 1, F.transform(F.sequence(F.lit(1), F.least(F.length(w) - 1, F.lit(PREFIX))), lambda i: F.left(w, i))).otherwise(F.array())
    asks = [_keys(sigs, "cut", lambda w: F.when((F.length(w) == 1) | (F.length(w) > 2), F.array(w)).otherwise(F.array())), _keys(sigs, "nick", lambda w: F.coalesce(F.try_element_at(nicknames, w), F.array()))]
    return asks, [_keys(sigs, "cut", prefixes), _keys(sigs, "nick", lambda w: F.array(w))]


def short_pairs(sigs: DataFrame, near: DataFrame) -> DataFrame:
    """a, b: a has a short word and up to two misspelt ones beside it where b has full ones; words are exchanged on both sides."""
    full = materialize(sigs.select("sig", "kind", "words").union(respelled(sigs, near).select("sig", "kind", F.array_sort("words").alias("words"))), "name-full")
    ask, give = (reduce(DataFrame.union, x) for x in short_keys(full))
    met = ask.toDF("a", "key").join(give.toDF("b", "key"), "key").filter("a <> b").select("a", "b").distinct()
    words = sigs.select("sig", "words")
    met = met.join(words.toDF("a", "wa"), "a").join(words.toDF("b", "wb"), "b")
    return materialize(met.filter(alignment("wa", "wb", short_cost) <= LINKED).select("a", "b"), "name-short")


def weak_edges(sigs: DataFrame, groups: DataFrame, common: DataFrame, short: DataFrame) -> DataFrame:
    """a, b: a group and the only other group that its short or incomplete spellings can mean."""
    nicknames = nickname_map()
    asks, gives = short_keys(sigs)
    # names of two words, the second misspelt too
    two = sigs.filter("size(words) = 2").select("sig", "kind", "words", F.explode(F.array(F.lit(0), F.lit(1))).alias("p")).select("sig", "kind", F.get("words", "p").alias("word"), F.get("words", 1 - F.col("p")).alias("other"))
    two = two.filter("length(other) between 7 and 64").withColumn("v", F.explode(F.array_append(one_less(F.col("other")), F.col("other"))))

    def second(of: Column) -> DataFrame:
        return two.select("sig", "kind", "v", F.explode(of).alias("w")).select("sig", F.xxhash64(F.lit("two"), "kind", "v", "w").alias("key"))

    word = F.col("word")
    asks.append(second(F.when(F.length("word") == 1, F.array("word")).otherwise(F.coalesce(F.try_element_at(nicknames, word), F.array()))))
    gives.append(second(F.when(F.length("word") > 1, F.array(F.left("word", F.lit(1)), word)).otherwise(F.array())))
    dropped = sigs.filter("size(words) > 2").select("sig", "kind", "words", F.posexplode("words").alias("p", "word")).join(F.broadcast(common.select(F.col("full").alias("word"))), "word", "left_semi")
    gives.append(dropped.select("sig", F.xxhash64(F.lit("drop"), "kind", F.array_join(F.filter("words", lambda w, i: i != F.col("p")), " ")).alias("key")).distinct())
    asks.append(sigs.filter("size(words) > 1").select("sig", F.xxhash64(F.lit("drop"), "kind", F.array_join("words", " ")).alias("key")))
    ask, give = (reduce(DataFrame.union, x) for x in (asks, gives))
    of = groups.select(F.col("node").alias("sig"), "label")
    # Of a key's groups the least, the greatest and the number tell whether a group has none, one or several others there.
    offered = give.join(of, "sig").groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count_distinct("label").alias("n"))
    wanted = ask.join(of, "sig").join(offered, "key")
    own = F.col("label")
    low, high = F.when(F.col("low") != own, F.col("low")).otherwise(F.col("high")), F.when(F.col("high") != own, F.col("high")).otherwise(F.col("low"))
    other = wanted.withColumns({"x": low, "y": high}).filter((F.col("n") > 1) | (F.col("x") != own))
    one = other.groupBy("label").agg(F.min("x").alias("x"), F.max("y").alias("y"), F.max("n").alias("n"), F.max(F.when((F.col("n") == 2) & (F.col("low") != own) & (F.col("high") != own), 1).otherwise(0)).alias("two"))
    one = materialize(one, "name-asked")
    exact = one.filter("x = y and n < 3 and two = 0").select(F.col("label").alias("a"), F.col("x").alias("b"))
    # the others with words misspelt besides
    met = short.join(of.join(one, "label", "left_anti").select("sig", "label").toDF("a", "la"), "a").join(of.toDF("b", "lb"), "b").filter("la <> lb")
    loose = met.groupBy("la").agg(F.min("lb").alias("low"), F.max("lb").alias("high")).filter("low = high").select(F.col("la").alias("a"), F.col("low").alias("b"))
    return exact.union(loose)


def link(names: DataFrame) -> DataFrame:
    """kind, name, group for every distinct non-blank name of rows (kind, name)."""
    with scratch(names.sparkSession) as keep:
        named, sigs, common = signatures(names)
        loops = sigs.select(F.col("sig").alias("a"), F.col("sig").alias("b"))
        near = near_words(sigs)
        groups = components(firm_edges(sigs, near).union(loops)).select("node", "label")
        short = short_pairs(sigs, near)
        for _ in range(WEAK_ROUNDS):
            weak = materialize(weak_edges(sigs, groups, common, short), "name-weak")
            merged = components(weak).toDF("label", "to")
            groups = materialize(groups.join(merged, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "name-groups")
        groups = groups.toDF("sig", "group")
        return keep(named.join(groups, "sig").select("kind", "name", "group"), "name-linked")
