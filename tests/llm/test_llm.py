"""Small fixtures, odd rows and brute force for each operator; ``odd`` rows: nulls, empty and very long texts, repeats."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.llm import confusables, leakage, names, packing, personal, pieces, sentences, stuffing

DOCS = "document_key long, text string, lang string, id string, k string, start_pos int"
PARTIES = [(1, "person", "Daniel R. Casmümbe"), (2, "person", "Élodie Zanrodez"), (3, "organisation", "Passtudran Laboratories Ltda."), (4, "organisation", "Torviborida & Ekvinard Shipping Corp."), (5, "person", "Elizabeth Pasfrepamoor"), (6, "person", "Eduardo Pasfrepamoor"), (7, None, "x"), (None, "person", "y"), (8, "person", None)]


def docs(spark, rows):
    return spark.createDataFrame([(k, t, None, "clash", "clash", 9) for k, t in rows], DOCS)


def parties(spark):
    return spark.createDataFrame(PARTIES, "party_id long, party_class string, legal_name string").withColumn("text", F.lit("clash"))


# ---- 1


def test_lookalike_pairs(spark):
    long = "word " * 20_000
    df = docs(spark, [(1, "Nadia Bay"), (2, "Νаdіa​ Ｂay"), (3, "nadia bay"), (4, "Nadia Bay"), (5, None), (None, "Nadia Bay"), (6, ""), (7, "​"), (8, long), (9, long.replace("w", "ｗ", 1)), (2, "Νаdіa​ Ｂay")])
    got = {tuple(r) for r in confusables.lookalike_pairs(df, "document_key", "text").collect()}
    assert got == {(1, 2), (2, 4), (6, 7), (8, 9)}
    ex = spark.createDataFrame([(1, 1, "a", "Bay"), (2, 1, "a", "Вay"), (3, 2, "a", "Вay"), (4, 1, "b", "Вay"), (5, None, "a", "Вay")], "extraction_id long, document_key long, extraction_class string, extraction_text string")
    assert {tuple(r) for r in confusables.found(df, ex).filter("record_type = 'extractions'").collect()} == {("extractions", 1, 2)}
    assert confusables.lookalike_pairs(df.limit(0), "document_key", "text").count() == 0
    links = confusables.lookalike_classes(df, "document_key", "text").collect()
    assert sorted((r.id, r.n_links) for r in links) == [(1, 2), (2, 2), (2, 2), (4, 2), (6, 1), (7, 1), (8, 1), (9, 1)] and len({r.class_id for r in links}) == 3
    assert confusables.lookalike_classes(df.limit(0), "document_key", "text").count() == 0
    assert {r.consistent_text for r in confusables.with_consistent_text(df.filter("document_key in (1, 2)")).collect()} == {"Nadia Bay"}


def test_lookalike_pairs_equal_brute_force(spark):
    rng = random.Random(4)
    base = ["Bay", "Cat", "é1"]
    rows = [(k, "".join(rng.choice({"B": "BВ", "C": "CС", "a": "aа", "1": "1１"}.get(c, c)) for c in rng.choice(base))) for k in range(60)]
    look = {k: confusables.skeleton(t) for k, t in rows}
    want = {(a, b) for a, x in rows for b, y in rows if a < b and x != y and look[a] == look[b]}
    assert {tuple(r) for r in confusables.lookalike_pairs(docs(spark, rows), "document_key", "text").collect()} == want


def test_a_hot_spelling_does_not_meet_itself(spark):
    rows = docs(spark, []).unionByName(docs(spark, [(0, "Bay")]).drop("document_key").crossJoin(spark.range(20_000).withColumnRenamed("id", "document_key")))
    rows = rows.unionByName(docs(spark, [(50_000, "Вay"), (50_001, "Bаy")]))
    pairs = confusables.lookalike_pairs(rows, "document_key", "text")
    assert pairs.count() == 2 * 20_000 + 1
    links = {r.n_links: r.n for r in confusables.lookalike_classes(rows, "document_key", "text").groupBy("n_links").agg(F.count("*").alias("n")).collect()}
    assert links == {2: 20_000, 20_001: 2}


# ---- 2


def test_personal_information(spark):
    t = (
        "Dr. Daniel R. Casmümbe (d.casmumbe+x (at) ward7 dot example; +1 (212) 555-0175) lives at 100 Weaver Rd., Apt. 7, Bad Rauhen; SSN 937-23-3970.\n"
        "Zanrodez, É. of Passtudran Laboratories Ltda. signed no. 644-621-2521 and lot 978-9-4911-5578-9 at 7.45 a.m. @kestrelbay_example\n\n"
        "ELIZABETH PASFREPAMOOR\nCalle Old Mill 276, 29170 Hartsmere\nT: 020 7946 0266\nE: e.p@x.example\n30323719-M"
    )
    df = docs(spark, [(1, t), (2, None), (3, ""), (None, t), (4, "x " * 50_000)])
    got = sorted((r.pii_kind, t[r.start_pos : r.end_pos]) for r in personal.found(df, parties(spark)).collect())
    assert got == sorted([
        ("person_name", "Daniel R. Casmümbe"), ("email", "d.casmumbe+x (at) ward7 dot example"), ("phone", "+1 (212) 555-0175"), ("street_address", "100 Weaver Rd., Apt. 7, Bad Rauhen"), ("identity_number", "937-23-3970"), ("person_name", "Zanrodez, É."),
        ("person_name", "ELIZABETH PASFREPAMOOR"), ("street_address", "Calle Old Mill 276, 29170 Hartsmere"), ("phone", "020 7946 0266"), ("email", "e.p@x.example"), ("identity_number", "30323719-M"),
    ])
    red = {r.document_key: r.text for r in personal.redacted(df, parties(spark)).collect()}
    assert red[1].startswith("Dr. [NAME] ([EMAIL]; [PHONE]) lives at [ADDRESS]; SSN [ID].") and red[2] is None and red[3] == ""
    assert personal.found(df.limit(0), parties(spark)).count() == 0 and personal.found(df, parties(spark).limit(0)).filter("pii_kind = 'email'").count() == 2


def spans_of(text):
    lexicon = personal.Lexicon({"daniel", "eduardo"}, {"^ca", "cas", "asm", "smu", "mum", "umb", "mbe", "be$"})
    return [(k, text[a:b]) for a, b, k in personal.personal_spans(text, lexicon)]


def test_nothing_is_cut_at_a_distance():
    local = "x" * 300 + ".y"
    assert spans_of(f"write to {local}@ward.example now") == [("email", f"{local}@ward.example")]
    street = "Rua " + "Santa " * 1 + "Verde, 276, " + "apto. 4, " * 30 + "1000-123 Kestrel"
    assert spans_of(f"mora na {street}, desde ontem") == [("street_address", street)]
    far = "5 Long Street, " + "Flat 12, " * 1 + "Kestrel Bay AB1 2CD"
    assert ("street_address", far) in spans_of("word " * 60 + far + " and more " * 40)


def test_numbers_in_running_text():
    assert spans_of("He left 020 7946 0266 and (646) 555 0184 with us.") == [("phone", "020 7946 0266"), ("phone", "(646) 555 0184")]
    assert spans_of("A caller on 212-555-0168 said that the number 992 92 8541 was hers.") == [("phone", "212-555-0168"), ("identity_number", "992 92 8541")]
    assert spans_of("Lot no. 020 7946 0266 and invoice 0997 727 83, contract number 644-621-2521.") == []


@pytest.mark.parametrize("text,want", [("昨天欧阳明轩向董事会报告。", ["欧阳明轩"]), ("合同由陈思远签署，与会者有王小明。", ["陈思远", "王小明"]), ("付款\n安全的货物", []), ("山田太郎さんが来た。契約番号は12で、田中一郎と話した。", ["山田太郎", "田中一郎"]), ("整理番号 内部用\n本契約は有効", [])])
def test_names_in_han_characters(text, want):
    assert [t for k, t in spans_of(text) if k == "person_name"] == want


def test_many_spans_take_time_in_proportion():
    import time

    took = []
    for n in (2_000, 16_000):
        began = time.perf_counter()
        assert len(spans_of("a.b@c.example, " * n)) == n
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * 4 * took[0]


# ---- 3


@pytest.mark.parametrize("text,lang,want", [
    ('The gate opens at 4 a.m. "It was late," said Dr. B. Ray. "We all went home."', "en", ["The gate opens at 4 a.m.", '"It was late," said Dr. B. Ray.', '"We all went home."']),
    ('"I slept badly. The room was cold," he said. Who paid?! "Stop!" was painted... and left... Then', "en", ['"I slept badly.', 'The room was cold," he said.', "Who paid?!", '"Stop!" was painted... and left...', "Then"]),
    ("Am 1. Oktober gem. § 4 Abs. 1 S. 2 usw. Der Rest fragte: „Wer?“ Die Ware", "de", ["Am 1. Oktober gem. § 4 Abs. 1 S. 2 usw.", "Der Rest fragte: „Wer?“", "Die Ware"]),
    ("« Rien ne presse. Revenez lundi », a dit M. Paul le 3 ! « Qui ? » Le lot", "fr", ["« Rien ne presse.", "Revenez lundi », a dit M. Paul le 3 !", "« Qui ? »", "Le lot"]),
    ("他问：“何时到？”随后没有人回答。“好。”他说。谁？“走。”", "zh", ["他问：“何时到？”随后没有人回答。", "“好。”他说。", "谁？", "“走。”"]),
    ("「明日届きます。急ぎません。」と答えた。原本は…誰も。", "ja", ["「明日届きます。", "急ぎません。」と答えた。", "原本は…誰も。"]),
    ("डॉ. Ann Lee ने Foo Ltd. को दिया। कौन है?", "hi", ["डॉ. Ann Lee ने Foo Ltd. को दिया।", "कौन है?"]),
    ("قال د. Ann Lee نعم. من يحتفظ؟", "ar", ["قال د. Ann Lee نعم.", "من يحتفظ؟"]),
    ("สัญญามีมูลค่ารวมUSD 84,933 สินค้าล็อต 12 อยู่ที่ Novaluz แล้ว Ann Leeรับสินค้าแล้ว", "th", ["สัญญามีมูลค่ารวมUSD 84,933", "สินค้าล็อต 12 อยู่ที่ Novaluz แล้ว", "Ann Leeรับสินค้าแล้ว"]),
    ("Ref. no. 1-2 – copy\nTERMS\n(a) one item\n2) two items.\nName\t4 kg | x\n/s/ Ann Lee\nT: +1 212 555 0101", "en", ["Ref. no. 1-2 – copy", "TERMS", "(a) one item", "2) two items.", "Name\t4 kg | x", "/s/ Ann Lee", "T: +1 212 555 0101"]),
    ("", None, []), (" \n ", "en", []),
])
def test_sentence_rules(text, lang, want):
    thai = frozenset({"สัญญ", "สินค", "*รับ"})
    assert [text[a:b] for a, b in sentences.units(text, lang, thai)] == want


def test_thai_clauses_are_learned_from_the_lines_of_the_corpus(spark):
    rows = docs(spark, [(k, t) for k, t in enumerate(["วันนี้ฝนตกหนัก", "วันนี้ร้อนมาก แต่ไม่มีลม", "Ann Leeรับสินค้าแล้ว", "Bob Royรับสินค้าแล้ว วันนี้ฝนตก", None, "", "no Thai at all"])])
    starts = sentences.thai_starts(rows)
    assert starts == frozenset({"วันน", "*รับ"})
    cut = lambda t: [t[a:b] for a, b in sentences.units(t, "th", starts)]
    assert cut("ไม่มีลม วันนี้ร้อน มาก Sue Kayรับของ") == ["ไม่มีลม", "วันนี้ร้อน มาก", "Sue Kayรับของ"]
    assert sentences.thai_starts(rows.limit(0)) == frozenset()


def test_rules_see_the_whole_block():
    t = "Kopie an die " + "Donaudampfschifffahrtsgesellschaftsvertragsnr. 12 ging ab. Der Rest blieb."
    assert [t[a:b] for a, b in sentences.units(t, "de")] == [t[: t.index(" Der")], "Der Rest blieb."]


def test_sentence_spans(spark):
    df = docs(spark, [(1, "One. Two."), (2, None), (3, ""), (None, "x."), (1, "One. Two."), (4, "Long sentence here. " * 5000)])
    got = sentences.found(df)
    assert {tuple(r) for r in got.filter("document_key < 4").collect()} == {(1, 0, 4), (1, 5, 9)} and got.filter("document_key = 1").count() == 4 and got.filter("document_key = 4").count() == 5000
    assert sentences.found(df.limit(0)).count() == 0


def test_wrapped_text_equals_unwrapped():
    import textwrap

    one = "The parish archive carefully listed the insurance schedule before anyone could object to it. " * 3 + "Nobody came at 5 p.m. on Monday, cf. p. 12 of the file. It rained."
    wrapped = "\n".join(textwrap.wrap(one, 70))
    squeeze = lambda t: [" ".join(t[a:b].split()) for a, b in sentences.units(t, "en")]
    assert squeeze(wrapped) == squeeze(one) and len(squeeze(one)) == 5


# ---- 5


@pytest.mark.parametrize("text,kind,want", [
    ("Daniel Casmümbe", "person", 1), ("Casmumbe, D.", "person", 1), ("CASMÜMBE Daniel", "person", 1), ("Dan Casmümbbe", "person", 1), ("Sr. Daniel R. Casmübme", "person", 1), ("D. R. Casmümbe", "person", 1), ("Daniel Q. Casmümbe", "person", None), ("Peter Casmümbe", "person", None), ("Élodie Zаnrodez", "person", 2),
    ("Liz Pasfrepamoor", "person", 5), ("E. Pasfrepamoor", "person", None), ("Passtudran Labs Ltda", "organisation", 3), ("Passtudran", "organisation", 3), ("Laboratories Passtudran Ltda.", "organisation", 3), ("Passtudran Foods Ltda.", "organisation", None), ("Ekvinard e Torviborida Shpg. Corporation", "organisation", 4),
    ("Torviborida & Ekvinard Shpiping", "organisation", 4), ("", "person", None), ("x", "organisation", None),
])
def test_spellings(spark, text, kind, want):
    marked = {"person": frozenset(["daniel", "elodie", "elizabeth", "eduardo"]), "organisation": frozenset(["laboratories", "shipping", "foods"])}[kind]
    costs = {i: (names.person_cost if k == "person" else names.organisation_cost)(text, n, marked) for i, k, n in PARTIES if k == kind and i and n}
    costs = {i: c for i, c in costs.items() if c is not None}
    best = [i for i, c in costs.items() if c <= min(costs.values()) + 0.01]
    assert (best[0] if len(best) == 1 else None) == want


def _typo(rng, s):
    """One edit: a letter left out, put in or changed, or two neighbours swapped."""
    i = rng.randrange(len(s) - 1)
    return rng.choice([s[:i] + s[i + 1 :], s[:i] + rng.choice("abxyz") + s[i:], s[:i] + s[i + 1] + s[i] + s[i + 2 :], s[:i] + rng.choice("abxyz") + s[i + 1 :]])


def test_segment_join_loses_no_pair(spark):
    rng = random.Random(15)
    made = lambda n: "".join(rng.choice("abcdeklmnorst") for _ in range(n))
    registered = sorted({made(n) for n in range(1, 15) for _ in range(25)} | {"ng", "li", "wu", "abcdefghi"})
    words = {"abdcefghx", "li", "lo"}
    for w in registered:
        for _ in range(3):
            x = w
            for _ in range(names.allowed(len(w))):
                x = _typo(rng, x)
            words.add(x)
    want = {(a, b) for a in words for b in registered if names.edits(a, b, names.allowed(len(b))) <= names.allowed(len(b))}
    df = lambda rows: spark.createDataFrame([(w,) for w in rows], "word string")
    got = {tuple(r) for r in names.near_words(df(sorted(words)), df(registered)).collect()}
    assert got == want and ("abdcefghx", "abcdefghi") in got and ("li", "li") in got and ("lo", "li") not in got


def test_links_equal_brute_force(spark):
    rng = random.Random(5)
    legal = [(k, "person", f"{g} {''.join(rng.choice(['ka', 'lo', 'mi', 'ren', 'tos']) for _ in range(rng.randint(1, 4)))}") for k, g in enumerate(["Daniel", "Maria", "Robert", "Zuzana", "Thandiwe"] * 6)]
    mentions = sorted({_typo(rng, n) if rng.random() < 0.7 else n for _, _, n in legal for _ in range(6)})
    known = frozenset(names.plain(n).split()[0] for _, _, n in legal)
    want = set()
    for m in mentions:
        costs = {i: c for i, _, n in legal if (c := names.person_cost(m, n, known)) is not None}
        near = [i for i, c in costs.items() if c <= min(costs.values()) + 0.01]
        if len(near) == 1:
            want.add((m, near[0]))
    p = spark.createDataFrame(legal, "party_id long, party_class string, legal_name string")
    rows = spark.createDataFrame([(m, "person") for m in [*mentions, mentions[0], None]], "text string, kind string")
    assert {(r.text, r.party_id) for r in names.link_spellings(rows, p).collect()} == want
    assert names.link_spellings(rows.limit(0), p).count() == 0 and names.link_spellings(rows, p.limit(0)).count() == 0


def test_kinds_of_business_come_from_the_table(spark):
    legal = [(k, "organisation", f"{n} {kind}") for k, (n, kind) in enumerate((n, kind) for n in ("Zubrano", "Kelwick", "Orlotta") for kind in ("Tanneries", "Orchards"))] + [(10, "organisation", "Marrow Lighting")]
    p = spark.createDataFrame(legal, "party_id long, party_class string, legal_name string")
    rows = spark.createDataFrame([(t, "organisation") for t in ("Zubrano Tann.", "Kelwick Orchrds", "Orlota Tanneries", "Orlotta", "Marrow Lightng", "Tanneries Zubrano", "Zubrano Lighting")], "text string, kind string")
    assert {(r.text, r.party_id) for r in names.link_spellings(rows, p).collect()} == {("Zubrano Tann.", 0), ("Kelwick Orchrds", 3), ("Orlota Tanneries", 4), ("Marrow Lightng", 10), ("Tanneries Zubrano", 0)}


@pytest.mark.parametrize("short,name,want", [("danny", "daniel", True), ("tilly", "matilda", False), ("jo", "joanna", True), ("vicky", "victoria", True), ("mario", "maria", False), ("zuza", "zuzana", True), ("thandi", "thandiwe", True), ("bob", "robert", True), ("anna", "hanna", True), ("peter", "paul", False)])
def test_short_forms(short, name, want):
    assert names.is_short_form(short, name) == want


def test_linked_extractions(spark):
    ex = spark.createDataFrame([(1, 9, "who", "Dan Casmümbe", "c"), (2, 9, "who", "Daniel R. Casmümbe", "c"), (3, 9, "when", "Dan Casmümbe", "c"), (4, 9, "who", None, "c"), (5, None, "who", "Dan Casmümbe", "c"), (6, 9, "who", "z" * 5000, "c"), (1, 9, "who", "Dan Casmümbe", "c")], "extraction_id long, project_id long, extraction_class string, extraction_text string, kind string")
    classes = spark.createDataFrame([(9, "who", "a natural person, as named"), (9, "when", "a date")], "project_id long, class_id string, description string")
    assert [tuple(r) for r in names.found(ex, parties(spark), classes).collect()] == [(1, 1)]


# ---- 6


def test_pieces():
    rng = random.Random(6)
    for _ in range(60):
        t = "".join(rng.choice(["word ", "Sentence ends. ", "Next one! ", "\n\n", "clause, ", "x" * rng.randint(1, 60)]) for _ in range(rng.randint(0, 120)))
        limit, overlap = rng.randint(20, 300), rng.randint(0, 60)
        spans = pieces.pieces(t, limit, overlap)
        assert all(b - a <= limit for a, b in spans) and spans[0][0] == 0 and spans[-1][1] == len(t)
        assert all(x[0] < y[0] <= x[1] for x, y in zip(spans, spans[1:])) and (len(spans) == 1) == (len(t) <= limit)


def test_no_tiny_pieces_at_the_edges():
    t = "TERMS OF SUPPLY\n\n" + "x" * 900 + ". " + "y" * 900 + ".\n\nEnd"
    spans = pieces.pieces(t, 1500, 150)
    assert len(spans) == 2 and min(b - a for a, b in spans) > 700


def test_piece_spans(spark):
    t = "A sentence of some length. " * 40
    df = docs(spark, [(1, t), (2, None), (3, ""), (None, t), (4, "short"), (5, t)]).withColumn("chunk_chars", F.when(F.col("document_key") != 5, 100)).withColumn("overlap_chars", F.lit(27))
    rows = pieces.piece_spans(df, with_text=True).orderBy("document_key", "piece").collect()
    one = [r for r in rows if r.document_key == 1]
    assert len(one) >= 10 and all(len(r.text) <= 100 and r.text.startswith("A ") for r in one) and {(r.document_key, r.n_pieces) for r in rows if r.document_key != 1} == {(3, 1), (4, 1), (5, 1)}
    projects = spark.createDataFrame([(1, 100, 20), (None, 5, 1)], "project_id long, chunk_chars int, overlap_chars int")
    known = df.drop("chunk_chars", "overlap_chars").withColumn("project_id", F.when(F.col("document_key") != 5, 1))
    assert [r.document_key for r in pieces.found(known, projects).collect()] == [1] and pieces.found(known.limit(0), projects).count() == 0


# ---- 7


def test_boundaries_are_optimal():
    rng = random.Random(7)
    from itertools import combinations

    for _ in range(60):
        sizes = sorted(rng.sample(range(1, 40), rng.randint(1, 8)))
        counts = [rng.randint(1, 9) for _ in sizes]
        most = rng.randint(1, 4)
        def waste(bounds):
            return sum(c * (min(b for b in bounds if b >= s) - s) for s, c in zip(sizes, counts))
        best = min(waste([*x, sizes[-1]]) for n in range(min(most, len(sizes))) for x in combinations(sizes[:-1], n))
        got = packing.boundaries(sizes, counts, most)
        assert len(got) <= most and got[-1] == sizes[-1] and waste(got) == best


def test_containers(spark):
    rng = random.Random(8)
    rows = [(k, " ".join(["word"] * rng.randint(0, 90))) for k in range(400)] + [(400, None), (401, ""), (7, "word word"), (None, "x"), (402, "word " * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("container", F.lit("clash"))
    specs = spark.createDataFrame([(1, 64), (2, 512), (1, 64), (3, None), (4, 0)], "spec_id int, capacity_tokens int")
    got = packing.containers(df, specs).collect()
    tokens = {(r.doc_id): r.n_tokens for r in packing.token_counts(df.filter("doc_id <> 7"), "doc_id", "text").collect()}
    for spec, cap in ((1, 64), (2, 512)):
        own = [r for r in got if r.spec_id == spec]
        fill = {}
        for r in own:
            fill.setdefault(r.container, []).append(r)
        assert all(sum(x.n_tokens for x in rs) <= cap and sorted(x.position for x in rs) == list(range(len(rs))) for rs in fill.values())
        assert sorted(fill) == list(range(len(fill)))
        whole = {}
        for r in own:
            if r.doc_id != 7:
                whole[r.doc_id] = whole.get(r.doc_id, 0) + r.n_tokens
        assert whole == tokens and all(r.piece == 0 for r in own if tokens.get(r.doc_id, 0) <= cap) and sum(r.doc_id == 7 for r in own) == 2
        assert sum(x.n_tokens for x in own) / (len(fill) * cap) > 0.9
    assert packing.containers(df.limit(0), specs).count() == 0 and packing.containers(df, specs.limit(0)).count() == 0
    alone = packing.containers(df, specs, rest=False).filter("spec_id = 1").collect()
    tokens_in = {}
    for r in alone:
        tokens_in[r.container] = tokens_in.get(r.container, 0) + r.n_tokens
    assert len(alone) == sum(r.spec_id == 1 for r in got) and max(tokens_in.values()) <= 64 and len(tokens_in) > len({r.container for r in got if r.spec_id == 1})


def test_a_bucket_has_salts_by_its_count(spark, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_SALT", 50)
    df = spark.createDataFrame([(k, "word " * (3 if k % 3 else 1 + k % 7)) for k in range(900)], "doc_id long, text string")
    got = packing.containers(df, spark.createDataFrame([(1, 32)], "spec_id int, capacity_tokens int")).collect()
    assert len({(r.container, r.position) for r in got}) == len(got) == 900


# ---- 8


def test_leaks(spark):
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(60))) for k in range(20)]
    noise = lambda n: " ".join(f"z{rng.randrange(5000)}" for _ in range(n))
    rows, want = [], set()
    for k in range(40):
        i, t = items[k % 20]
        w = t.split()
        n = 26 if k % 4 else 11
        a = rng.randrange(60 - n)
        part = w[a : a + n]
        if n > 20:
            for j in range(5, n, 8):
                part[j] = "other"
            want.add((k, i))
        rows.append((k, f"{noise(50)} {', '.join(part).upper().replace('W', 'Ｗ', 1)}! {noise(40)}"))
    rows += [(100, None), (101, ""), (None, items[0][1]), (102, noise(30_000)), (103, items[3][1]), (103, items[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    ev = spark.createDataFrame([*items, items[0], (None, "x y z"), (50, None), (51, "")], "item_id long, text string")
    assert {tuple(r) for r in leakage.found(df, ev).collect()} == want | {(103, 3)}
    kept = {r.doc_id: r for r in leakage.without_leaks(df, ev).collect()}
    assert kept[103].dropped and kept[103].text is None and kept[102].removed_chars == 0 and "OTHER" not in kept[1].text and kept[1].text.startswith("z")
    assert leakage.found(df.limit(0), ev).count() == 0 and leakage.found(df, ev.limit(0)).count() == 0


def test_automaton_knows_all_and_only_substrings():
    rng = random.Random(10)
    items = [(k, [rng.choice("abc") for _ in range(rng.randint(1, 14))]) for k in range(5)]
    a = leakage.Automaton(items)
    parts = {tuple(w[i:j]) for _, w in items for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
    for _ in range(400):
        x = [rng.choice("abc") for _ in range(rng.randint(1, 8))]
        s = 0
        for c in x:
            s = a.next[s].get(a.ids.get(c, ""), -1) if s >= 0 else -1
        assert (s >= 0) == (tuple(x) in parts)
        if s >= 0 and len(x) >= leakage.SEED:
            ends = {(n, k) for n, (_, w) in enumerate(a.items) for k in range(len(w)) if w[max(0, k - len(x) + 1) : k + 1] == x}
            assert ends <= set(a.ends[s])


# ---- 9

CLEAN = "The harbour committee met on Monday and discussed the budget. Two members asked for a new survey of the east gate. Nobody objected, so the clerk wrote it down. "
SPAM = ["cheap blinds, blinds sale, buy blinds, blinds near me, " * 12, "#gardenhose #phonecase #gardenhosebest #blinds " * 15, "\n".join(f"Tax Forms - www.shop.test/p{k}" for k in range(30)), "Home · Login · Cart · Home · Next page · Blinds (3) · Home · Login · " * 8, "Phone Case SALE $31 Blinds SALE $8 " * 10, "Buy tax software and tax software with best tax software here. " * 9]
HAM = [CLEAN * 4, "1. ten sacks of sand\n2. nine sacks of sand\n3. eight sacks of sand", "Name\t4 kg | 2020-01-01\nName\t5 kg | 2020-01-02", CLEAN + "\n\nSources:\nhttps://a.example/1\nhttps://a.example/2", "", "The tax software was tested in Rome on day 1, and the tax software held.\n" * 3]


def test_rules_of_the_weak_labels():
    assert all(stuffing.spam_share(t) > 0.5 for t in SPAM), [stuffing.spam_share(t) for t in SPAM]
    assert all(stuffing.spam_share(t) < 0.5 for t in HAM), [stuffing.spam_share(t) for t in HAM]
    assert stuffing.spam_share(CLEAN + "\n\n" + SPAM[0]) > 0.5 > stuffing.spam_share(CLEAN * 8 + "\n\n" + SPAM[0])
    assert all(len(stuffing.page_features(t)) == len(stuffing.FEATURES) for t in [*SPAM, *HAM, "x", "。"])


def test_spam_pages(spark):
    rows = [(k, t, f"h{k % 3}" if k % 4 else None) for k, t in enumerate([*SPAM, *HAM] * 5)]
    rows += [(900, None, "h1"), (None, SPAM[0], "h1"), (901, CLEAN * 2000, "h1"), (0, SPAM[0], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"host": F.lit("clash"), "score": F.lit("clash")})
    scores = stuffing.page_scores(df)
    assert scores.count() == len(rows) - 1
    assert {r.doc_id for r in stuffing.found(df).collect()} == {k for k, t, _ in rows if t in SPAM and k is not None}
    assert stuffing.found(df.limit(0)).count() == 0 and stuffing.found(df.filter("doc_id = 1")).count() == 1


def test_trees_learn_held_out_rows():
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.random((900, 4))
    y = ((x[:, 1] > 0.4) & (x[:, 3] < 0.7)).astype(float)
    model = stuffing.Trees(x[:600], y[:600])
    assert ((model.predict(x[600:]) > 0.5) == (y[600:] > 0.5)).mean() > 0.95


def _page(rng, spam):
    """A page whose label is known from how it is made, not from the rules."""
    keys = rng.sample(["blinds", "garden hose", "office chair", "tax forms", "roof tiles", "phone case"], 2)
    if spam:
        return rng.choice([", ", " | ", "\n"]).join(f"{rng.choice(['buy', 'cheap', 'best', 'free'])} {rng.choice(keys)}" for _ in range(rng.randint(20, 80)))
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ren", "tos", "ur", "bel", "da"]) for _ in range(rng.randint(2, 4)))
    return rng.choice([" ", "\n"]).join(f"The {word()} {word()} the {word()} near a {word()} on day {rng.randrange(99)}." for _ in range(rng.randint(3, 40)))


def test_forest_is_no_single_threshold_and_right_on_held_out_pages():
    import numpy as np

    rng = random.Random(12)
    made = [rng.random() < 0.3 for _ in range(600)]
    pages = [_page(rng, s) for s in made]
    labels = np.array([float(stuffing.spam_share(t) > 0.5) for t in pages])
    x = np.array([stuffing.page_features(t) for t in pages])
    forest = stuffing.Trees(x[:400], labels[:400])
    assert ((forest.predict(x[400:]) > 0.5) == np.array(made[400:])).mean() > 0.99
    assert "spam_share" not in stuffing.FEATURES and len({f for t in forest.trees if isinstance(t, tuple) for f in [t[0]]}) > 1


def test_hosts_turn_close_votes():
    import numpy as np

    rng = np.random.default_rng(3)
    host = np.repeat(np.array(["a", "b"]), 200)
    label = (rng.random(400) < np.where(host == "a", 0.9, 0.05)).astype(float)
    vote = np.clip(0.5 + 0.1 * (label - 0.5) + rng.normal(0, 0.2, 400) + np.where(host == "a", 0.1, -0.1), 0, 1)
    assert stuffing.host_weight(vote, host, label) == max(stuffing.HOST_WEIGHTS)
    assert stuffing.host_weight(vote[:0], host[:0], label[:0]) == stuffing.HOST_WEIGHTS[0]


def test_smoothing_turns_pages_of_bad_hosts(spark):
    df = spark.createDataFrame([(0.45, 0.6), (0.45, 0.05), (0.55, 0.6), (0.55, 0.02), (1.0, 0.0), (0.0, 1.0)], "v double, r double")
    got = [r.s > 0.5 for r in df.select(stuffing.smoothed(F.col("v"), F.col("r"), F.lit(0.1), 0.5).alias("s")).collect()]
    assert got == [True, False, True, False, True, False]
