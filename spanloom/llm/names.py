"""Problem 5: variant spellings of names typed by people.

Method: pigeonhole segment join. Each registered name's distinctive words are cut into k+1 segments; an inverted index
holds the segments, the mention's words look up their substrings at every position an edit could have shifted them to,
and a banded edit distance verifies the hits. A swap of two letters over a segment's border would spoil two segments, so
the index also holds the segments of the word with the letters at each border swapped. Order, initials, short forms of
given names, titles, legal forms and abbreviations are then compared word by word. Which words are given names and which
only tell an organisation's kind of business is read from the registered names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import category, normalize

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lookalike import skeleton
from ..session import cut

# Titles, legal forms, joining words.
TITLES = set("mr mrs ms miss dr dra prof profa sr sra srta don dona hr herr fr frau mme mlle capt captain gov governor sir judge senhor senhora senor senora monsieur madame".split())
INITIAL_TITLES = {"m", "d"}
FORMS = {
    "ltd": "ltd", "limited": "ltd", "ltda": "ltda", "limitada": "ltda", "inc": "inc", "incorporated": "inc", "corp": "corp", "corporation": "corp", "llc": "llc", "ag": "ag", "aktiengesellschaft": "ag", "gmbh": "gmbh",
    "sa": "sa", "plc": "plc", "co": "co", "company": "co", "kg": "kg", "srl": "srl", "sarl": "sarl", "bv": "bv", "nv": "nv", "oy": "oy", "ab": "ab", "as": "as", "spa": "spa", "llp": "llp", "lp": "lp", "pty": "pty", "pte": "pte",
}
JOINERS = {"&", "+", "and", "e", "et", "y", "und", "u", "en", "i"}
# Short forms of given names that are no part of the name; what starts or ends the name follows by rule.
NICKNAMES = {
    "alexander": "sandy sasha", "alexandra": "sandra sasha", "anthony": "tony", "antonio": "tony toni tonio", "andrew": "drew", "anne": "nancy annie", "barbara": "babs", "catherine": "kate kitty", "charles": "chuck charlie", "christopher": "kit topher", "dorothy": "dolly dot",
    "edward": "ted ned teddy", "eduardo": "dudu", "eleanor": "nell nora", "elizabeth": "liz lizzie betty bess", "ernesto": "neto", "francis": "frank", "francisco": "paco chico pancho frank", "frances": "fanny", "giovanni": "gianni", "giuseppe": "beppe pino", "guillermo": "memo",
    "heinrich": "heinz heiner", "helen": "nell", "henry": "harry hank", "ignacio": "nacho", "isabel": "bel chabela", "jacob": "jake", "james": "jim jimmy", "jean": "jeannot", "jesus": "chuy", "joaquin": "quino", "johannes": "hans", "john": "jack", "jonathan": "jon", "jose": "ze pepe", "joseph": "joe joey",
    "josef": "sepp", "katherine": "kate katie", "kenneth": "kenny", "lawrence": "larry", "lucia": "lucy luz", "luis": "lucho", "manuel": "manolo", "margaret": "peggy maggie meg marge daisy", "maria": "mary mia", "martha": "patty", "mary": "polly molly", "matilda": "tilda", "michael": "mike mick mickey",
    "nadia": "nadja", "nathaniel": "nat nate", "patricia": "patty tricia", "peter": "pete", "rachel": "shelly", "richard": "dick rick ricky", "robert": "bob bobby bert", "rosario": "charo", "sarah": "sally", "sebastian": "bastian", "steven": "steve", "susan": "sue suzy", "theodore": "ted", "theresa": "tess",
    "thomas": "tom tommy", "viktor": "vitja", "virginia": "ginny", "walter": "walt", "wilhelm": "willi", "william": "bill billy will liam", "yara": "yaya",
}
ENDINGS = ("ey", "ie", "y", "i", "a", "o", "e")
LONG_FORMS = [(re.compile(r"\bsociedade anonima\b|\bsociedad anonima\b|\bsociete anonyme\b|\bs[./]? ?a\.?(?=$|[ ,])"), " sa "), (re.compile(r"\bg\.? ?m\.? ?b\.? ?h\b\.?"), " gmbh "), (re.compile(r"\bl\.? ?l\.? ?c\b\.?"), " llc "), (re.compile(r"\ba\.g\b\.?"), " ag "), (re.compile(r"\bgesellschaft mit beschrankter haftung\b"), " gmbh "), (re.compile(r"\blimited liability company\b"), " llc ")]
#: Registered words of at least so many letters may have so many edits; shorter ones have to be equal.
EDITS = ((9, 2), (4, 1))
K = EDITS[0][1]
#: A word of at least so many registered organisations, and of so large a share of them, tells only the kind of business.
KIND_NAMES, KIND_SHARE = 3, 0.005
#: What the description of a class for names of persons, of organisations holds.
CLASS_WORDS = {"person": "natural person", "organisation": "company"}


def allowed(length: int) -> int:
    """How many edits a registered word of that length may have."""
    return next((k for least, k in EDITS if length >= least), 0)


def plain(text: str) -> str:
    """Look-alikes folded, marks dropped, lower case."""
    return "".join(c for c in normalize("NFD", skeleton(text).lower()) if category(c) != "Mn").replace("ß", "ss").replace("ł", "l").replace("ø", "o")


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours as one edit, in a band of width ``most``; most + 1 if it is larger."""
    if a == b:
        return 0
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    big = most + 1
    before: list[int] = []
    row = [j if j <= most else big for j in range(m + 1)]
    for i in range(1, n + 1):
        last, before = before, row
        row = [big] * (m + 1)
        if i <= most:
            row[0] = i
        x = a[i - 1]
        low = big
        for j in range(max(1, i - most), min(m, i + most) + 1):
            d = before[j - 1] + (x != b[j - 1])
            if before[j] + 1 < d:
                d = before[j] + 1
            if row[j - 1] + 1 < d:
                d = row[j - 1] + 1
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == b[j - 1] and last[j - 2] + 1 < d:
                d = last[j - 2] + 1
            row[j] = d
            low = min(low, d)
        if low > most:
            return big
    return min(row[m], big)


def person_words(text: str) -> tuple[list[str], bool]:
    """(words without titles, whether the surname is known to come first)."""
    s = plain(text)
    turned = "," in s
    words = [w.strip(".") for w in re.findall(r"[^\W_]+(?:['’-][^\W_]+)*\.?", s)]
    while len(words) > 1 and (words[0] in TITLES or words[0] in INITIAL_TITLES and len(words) > 2 and len(words[1]) > 1 and not words[1] in TITLES and len(words[-1]) == 1):
        words = words[1:]
    raw = re.findall(r"[^\W_]+(?:['’-][^\W_]+)*", skeleton(text))
    if len(raw) > 1 and not turned and len(raw[-2]) > 2 and raw[-2].isupper() and not raw[-1].isupper():
        turned = True
    return words, turned


def organisation_words(text: str) -> tuple[list[str], str]:
    """(words without legal forms and joining words, legal form or '')."""
    s = plain(text)
    for pattern, form in LONG_FORMS:
        s = pattern.sub(form, s)
    words, form = [], ""
    for w in re.findall(r"[^\W_]+(?:['’-][^\W_]+)*|[&+]", s):
        if w in FORMS:
            form = FORMS[w]
        elif w not in JOINERS:
            words.append(w)
    return words, form


@lru_cache(maxsize=100_000)
def is_short_form(short: str, name: str) -> bool:
    """Whether ``short`` is a usual short form of a given name: listed, its start or end, or its start with an ending."""
    if short in NICKNAMES.get(name, "").split():
        return True
    if len(short) >= 2 and len(name) - len(short) >= 2 and name.startswith(short) or len(short) >= 4 and name.endswith(short):
        return True
    for end in ENDINGS:
        stem = short[: len(short) - len(end)]
        if short.endswith(end) and len(stem) >= 2 and len(name) - len(stem) >= 2:
            single = stem[:-1] if len(stem) > 2 and (stem[-1] == stem[-2] or stem.endswith("ck")) else stem
            if name.startswith(stem) and len(stem) >= 3 or name.startswith(single) and len(single) >= 2 and single != stem or len(stem) >= 4 and stem in name:
                return True
    return False


@lru_cache(maxsize=100_000)
def abbreviates(short: str, word: str) -> bool:
    """Whether ``short`` stands for the word: some of its letters in order with the first among them, the start of its
    consonants, another ending to the same stem, or a typo."""
    if short == word:
        return True
    if len(short) >= 2 and len(short) < len(word):
        letters = iter(word)
        if short[0] == word[0] and all(c in letters for c in short):
            return True
        consonants = "".join(c for c in word if c not in "aeiou")
        if len(short) >= 3 and consonants.startswith(short):
            return True
    same = next((k for k, (a, b) in enumerate(zip(short, word)) if a != b), min(len(short), len(word)))
    if same >= 5 and same >= 0.6 * len(word) and len(short) <= len(word) + 2:
        return True
    return len(word) >= 4 and edits(short, word, 1 if len(word) < 8 else 2) <= (1 if len(word) < 8 else 2)


def given_cost(mention: str, name: str, known: frozenset | set = frozenset()) -> int | None:
    """What it costs to read one given name as another: 0 equal, short form or initial, else edits; None if they differ.

    A mention that is a registered given name itself (in ``known``) is no other one, however near.
    """
    if mention == name:
        return 0
    if len(mention) == 1:
        return 0 if name.startswith(mention) else None
    if len(name) == 1:
        return 0 if mention.startswith(name) else None
    if mention in known:
        return None
    if is_short_form(mention, name):
        return 0
    if min(len(mention), len(name)) >= 3 and max(len(mention), len(name)) >= 4 and edits(mention, name, 1) <= 1:
        return 1
    if any(len(nick) >= 5 and edits(mention, nick, 1) <= 1 for nick in NICKNAMES.get(name, "").split()):
        return 1
    return None


def person_cost(text: str, legal: str, known: frozenset | set = frozenset()) -> float | None:
    """Edits and liberties between a mention and a registered person; None if the mention means somebody else.
    ``known``: those of the mention's words that are registered given names."""
    words, turned = person_words(text)
    name, _ = person_words(legal)
    if len(words) < 2 or len(name) < 2:
        return None
    best = None
    orders = [[*words[1:], words[0]]] if turned else [words, [*words[1:], words[0]]]
    for n, order in enumerate(orders):
        *given, surname = order
        *own, family = name
        d = edits(surname, family, allowed(len(family)))
        if d > allowed(len(family)):
            continue
        c = given_cost(given[0], own[0], known)
        if c is None or c + d > 2:
            continue
        middle, mine = given[1:], own[1:]
        extra = 0.0
        if middle and mine:
            if not (middle[0].startswith(mine[0]) or mine[0].startswith(middle[0])):
                continue
        elif middle or mine:
            extra = 0.25
            if middle and not mine:
                extra = 0.5
        cost = d + c + extra + 0.1 * n + (0.05 if len(given[0]) == 1 else 0)
        best = cost if best is None else min(best, cost)
    return best


def organisation_cost(text: str, legal: str, kinds: frozenset | set = frozenset()) -> float | None:
    """Edits and liberties between a mention and a registered organisation; None if the mention means another one.
    ``kinds``: those of both names' words that only tell a kind of business."""
    words, form = organisation_words(text)
    own, own_form = organisation_words(legal)
    own_kinds = [w for w in own if w in kinds]
    own = [w for w in own if w not in kinds] or own
    if len(own_kinds) and own_kinds[0] in own:
        own_kinds = []
    if form and own_form and form != own_form:
        return None
    total = 0.0
    left = list(words)
    for name in own:
        d, w = min(((edits(w, name, K), w) for w in left if w not in kinds or w == name), default=(K + 1, ""))
        if d > allowed(len(name)):
            return None
        total += d
        left.remove(w)
    if total > 2:
        return None
    missing = list(own_kinds)
    for w in left:
        kind = next((k for k in missing if abbreviates(w, k)), None) if w not in kinds else w if w in missing else None
        if kind is None:
            return None
        missing.remove(kind)
    return total + 0.2 * bool(missing) + 0.1 * (form != own_form)


def _edits_allowed(length: Column) -> Column:
    out = F.lit(0)
    for least, k in reversed(EDITS):
        out = F.when(length >= least, k).otherwise(out)
    return out


def _border(length: Column, i: Column, k: Column) -> Column:
    """Where segment i of k+1 begins in a word of that length."""
    return F.floor(length * i / (k + 1)).cast("int")


def _segments(word: Column) -> Column:
    """(length, number, text) of the segments of a registered word, and of the word with the letters at a border swapped."""
    n, k = F.length(word), _edits_allowed(F.length(word))

    def swapped(i: Column) -> Column:
        b = _border(n, i, k)
        return F.concat(F.substring(word, F.lit(1), b - 1), F.substring(word, b + 1, F.lit(1)), F.substring(word, b, F.lit(1)), F.substring(word, b + 2, n))

    forms = F.when(k > 0, F.concat(F.array(word), F.transform(F.sequence(F.lit(1), k), swapped))).otherwise(F.array(word))
    each = lambda w: F.transform(F.sequence(F.lit(0), k), lambda i: F.struct(n.alias("length"), i.alias("number"), F.substring(w, _border(n, i, k) + 1, _border(n, i + 1, k) - _border(n, i, k)).alias("piece")))
    return F.array_distinct(F.flatten(F.transform(forms, each)))


def _probes(word: Column) -> Column:
    """All (length, number, substring) under which a word can meet the segments of a registered word.

    A segment that no edit touched stands shifted by d if the edits before it changed the length by d and those behind it
    by the rest, so |d| + |rest| is at most the edits allowed.
    """
    n = F.length(word)
    out = []
    for delta in range(-K, K + 1):  # the registered word is so much longer
        length = n + delta
        k = _edits_allowed(length)
        for d in range(-K, K + 1):  # the segment stands so much further on in the word at hand
            cost = abs(d) + abs(-delta - d)
            if cost > K:
                continue
            for i in range(K + 1):
                start, end = _border(length, F.lit(i), k), _border(length, F.lit(i + 1), k)
                fits = (length > 0) & (k >= cost) & (k >= i) & (start + d >= 0) & (end + d <= n)
                out.append(F.when(fits, F.struct(length.alias("length"), F.lit(i).alias("number"), F.substring(word, start + d + 1, end - start).alias("piece"))))
    return F.array_distinct(F.filter(F.array(*out), lambda x: x.isNotNull()))


def _words(rows: DataFrame, text: str, own: bool) -> DataFrame:
    """(kind, text, word, role) of the distinct names: ``key`` words, that a registered name may be met by, and ``given``
    names. A mention's order is open, so its first and last word can be either; a registered name's is not."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for name, kind in zip(b.text, b.kind):
                if kind == "person":
                    words, _ = person_words(name)
                    if len(words) > 1:
                        out += [(kind, name, w, "key") for w in ({words[-1]} if own else {words[0], words[-1]})]
                        out += [(kind, name, w, "given") for w in ({words[0]} if own else set(words))]
                else:
                    out += [(kind, name, w, "key") for w in set(organisation_words(name)[0])]
            yield pd.DataFrame(out, columns=["kind", "text", "word", "role"])

    return rows.select(F.col(text).alias("text"), "kind").distinct().mapInPandas(scan, "kind string, text string, word string, role string")


def kind_words(words: DataFrame) -> DataFrame:
    """(word): words that so many registered organisations share that they only tell a kind of business.

    At most 1 / KIND_SHARE times the words of an average name, whatever the number of organisations.
    """
    own = words.filter("kind = 'organisation' and role = 'key'")
    total = own.agg(F.count_distinct("text").alias("n")).first()["n"]
    return own.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= max(KIND_NAMES, total * KIND_SHARE)).select("word")


@F.pandas_udf(T.IntegerType())
def _edits(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([edits(x, y, allowed(len(y))) - allowed(len(y)) for x, y in zip(a, b)], dtype="int32")


#: Not to be moved in front of the exchange that takes repeated pairs out and spreads the rest.
_edits = _edits.asNondeterministic()


@F.pandas_udf(T.DoubleType())
def _cost(text: pd.Series, legal: pd.Series, kind: pd.Series, known: pd.Series) -> pd.Series:
    """Null (nan) where the two don't mean the same."""
    out = [(person_cost if k == "person" else organisation_cost)(t, n, frozenset(w if w is not None else ())) for t, n, k, w in zip(text, legal, kind, known)]
    return pd.Series([float("nan") if x is None else x for x in out], dtype="float64")


def near_words(words: DataFrame, registered: DataFrame) -> DataFrame:
    """(word, registered_word): all pairs of the distinct words within the edits that the registered word allows.

    The join is on (length, segment number, segment text); no pair is formed that shares no segment. Pairs with more plain
    edits than swaps could explain are dropped at once, the rest spread evenly before their distance is worked out.
    """
    inverted = registered.select("word").distinct().select(F.col("word").alias("registered_word"), F.explode(_segments(F.col("word"))).alias("s")).select("registered_word", "s.*")
    parts = max(8, words.sparkSession.sparkContext.defaultParallelism)
    probes = words.select("word").distinct().repartition(parts).select("word", F.explode(_probes(F.col("word"))).alias("s")).select("word", "s.*")
    far = F.levenshtein("word", "registered_word", 2 * K)  # a swap is two of its edits; -1 is more
    met = probes.join(inverted, ["length", "number", "piece"]).filter((far >= 0) & (far <= 2 * _edits_allowed(F.col("length")))).select("word", "registered_word").distinct()
    return met.repartition(parts).withColumn("over", _edits("word", "registered_word")).filter("over <= 0").drop("over")


def link_spellings(mentions: DataFrame, parties: DataFrame, text_col: str = "text", kind_col: str = "kind") -> DataFrame:
    """(text, kind, party_id, cost): each distinct mention that means exactly one registered party, itself included.

    ``mentions`` has a text and a kind (``person`` or ``organisation``); ``parties`` has party_id, party_class and
    legal_name. Null texts, kinds, names and ids are left out; two parties at the same cost make the mention nobody's;
    repeated rows count once; an empty table on either side gives an empty result; other columns are ignored.

    Names are reduced to distinct strings and those to distinct words before the segment join, so a name that a third of
    all rows carry is looked up once. Which words are given names or kinds of business is joined to each name.
    """
    rows = mentions.select(F.col(text_col).alias("text"), F.col(kind_col).alias("kind")).dropna().filter("kind in ('person', 'organisation')")
    registered = parties.select(F.col("party_id").cast("long").alias("party_id"), F.col("party_class").alias("kind"), F.col("legal_name")).dropna().distinct()
    own = cut(_words(registered, "legal_name", True))
    kinds = cut(kind_words(own))
    marked = cut(own.filter("role = 'given'").select("kind", "word").distinct().unionByName(kinds.select(F.lit("organisation").alias("kind"), "word")))
    words = cut(_words(rows, "text", False).join(marked.withColumn("marked", F.lit(True)), ["kind", "word"], "left"))
    known = words.filter("marked and (role = 'given' or kind = 'organisation')").groupBy("kind", "text").agg(F.collect_set("word").alias("known"))
    own_kinds = own.filter("kind = 'organisation' and role = 'key'").join(kinds, "word", "left_semi").groupBy("kind", F.col("text").alias("legal_name")).agg(F.collect_set("word").alias("own_known"))
    index = own.filter("role = 'key'").join(kinds.withColumn("kind", F.lit("organisation")), ["kind", "word"], "left_anti").select("kind", F.col("text").alias("legal_name"), "word")
    bare = own.filter("kind = 'organisation'").select("kind", F.col("text").alias("legal_name")).distinct().join(index, ["kind", "legal_name"], "left_anti")
    index = cut(index.unionByName(bare.join(own.filter("role = 'key'").withColumnRenamed("text", "legal_name"), ["kind", "legal_name"]).select("kind", "legal_name", "word")))
    keys = words.filter("role = 'key'").select("kind", "text", "word")
    near = cut(near_words(keys, index))
    pairs = keys.join(near, "word").join(index.withColumnRenamed("word", "registered_word"), ["registered_word", "kind"]).select("text", "kind", "legal_name").distinct()
    pairs = pairs.join(known, ["kind", "text"], "left").join(own_kinds, ["kind", "legal_name"], "left")
    every = F.concat(F.coalesce("known", F.array().cast("array<string>")), F.coalesce("own_known", F.array().cast("array<string>")))
    scored = pairs.withColumn("cost", _cost("text", "legal_name", "kind", every)).filter(~F.isnan("cost"))
    scored = cut(scored.join(registered, ["kind", "legal_name"]).select("text", "kind", "party_id", "cost"))
    best = scored.groupBy("text", "kind").agg(F.min("cost").alias("least"), F.min_by("party_id", "cost").alias("party_id"))
    ties = scored.join(best.select("text", "kind", "least"), ["text", "kind"]).filter("cost <= least + 0.01").groupBy("text", "kind").agg(F.count_distinct("party_id").alias("n"))
    return best.join(ties.filter("n = 1"), ["text", "kind"]).select("text", "kind", "party_id", F.col("least").alias("cost"))


def name_mentions(extractions: DataFrame, schema_classes: DataFrame, class_words: dict[str, str] = CLASS_WORDS) -> DataFrame:
    """(extraction_id, text, kind) of the extractions whose class is for names, told by what its description holds."""
    kind = F.coalesce(*[F.when(F.col("description").contains(held), name) for name, held in class_words.items()])
    classes = schema_classes.select(F.col("project_id"), F.col("class_id").alias("extraction_class"), kind.alias("kind")).dropna().distinct()
    rows = extractions.select("extraction_id", "project_id", "extraction_class", F.col("extraction_text").alias("text")).dropna()
    return rows.join(classes, ["project_id", "extraction_class"]).select("extraction_id", "text", "kind")


def found(extractions: DataFrame, parties: DataFrame, schema_classes: DataFrame) -> DataFrame:
    """(extraction_id, party_id) of the mentions that mean a party but aren't spelled exactly as its legal name."""
    mentions = name_mentions(extractions, schema_classes)
    links = cut(link_spellings(mentions, parties))
    exact = parties.select(F.col("legal_name").alias("text"), F.col("party_id").cast("long").alias("party_id")).dropna().distinct()
    links = links.join(exact, ["text", "party_id"], "left_anti").select("text", "kind", "party_id")
    return mentions.join(links, ["text", "kind"]).select(F.col("extraction_id").cast("long").alias("extraction_id"), "party_id").distinct()
