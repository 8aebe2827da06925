from spanloom.llm import leakage


def found(passage):
    words = [f"a{k}" for k in range(30)] + passage + [f"b{k}" for k in range(30)]
    return leakage.Automaton([(1, [f"w{k}" for k in range(60)])]).passages(words)


def test_words_replaced_near_the_border_lose_no_passage():
    own = [f"w{k}" for k in range(20, 40)]
    for gone in ((1, 18), (2, 17), (1, 9, 18)):
        got = found(["x" if k in gone else w for k, w in enumerate(own)])
        assert got == [(1, 30, 50, 20, 20 - len(gone))], gone


def test_stock_phrases_with_a_chance_word_are_no_passage():
    own = [f"w{k}" for k in range(20, 37)]
    assert found(["x" if k == 15 else w for k, w in enumerate(own)]) == []
    assert found([f"w{k}" for k in range(20, 32)]) == []


def test_every_copy_counts():
    own = [f"w{k}" for k in range(20, 45)]
    words = [*own, *(f"a{k}" for k in range(9)), *own, "b", *own]
    assert leakage.Automaton([(1, [f"w{k}" for k in range(60)])]).passages(words) == [(1, 0, 25, 25, 25), (1, 34, 59, 25, 25), (1, 60, 85, 25, 25)]


def test_two_passages_on_one_diagonal():
    item = [f"w{k}" for k in range(120)]
    words = [w if 10 <= k < 35 or 80 <= k < 110 else f"x{k}" for k, w in enumerate(item)]
    assert leakage.Automaton([(1, item)]).passages(words) == [(1, 10, 35, 25, 25), (1, 80, 110, 30, 30)]


def test_a_short_run_hides_no_longer_passage_on_its_diagonal():
    item = [f"w{k}" for k in range(80)]
    passage = [w if (k - 40) % 6 != 4 else "other" for k, w in enumerate(item)]
    words = [item[k] if 10 <= k < 22 else passage[k] if 40 <= k < 64 else f"x{k}" for k in range(80)]
    assert [x[:3] for x in leakage.Automaton([(1, item)]).passages(words)] == [(1, 40, 64)]


def test_words_left_out_or_put_in():
    own = [f"w{k}" for k in range(20, 44)]
    assert [x[:3] for x in [*found(own[:11] + own[12:])]] == [(1, 30, 53)]
    assert [x[:3] for x in [*found(own[:12] + ["new"] + own[12:])]] == [(1, 30, 55)]


def test_equal_items_are_held_once():
    a = leakage.Automaton([(k, [f"w{n}" for n in range(30)]) for k in range(500)])
    assert len(a.items) == 1 and len(a.passages([f"w{n}" for n in range(30)])) == 500


ZH = "本协议自二零二五年一月二日起生效如有争议由仲裁机构裁决货物应当在港口交付并由双方共同检验数量与质量检验费用由买方承担并在三十日内付清全部款项"
TH = "สัญญานี้มีผลบังคับตั้งแต่วันที่สองมกราคมและข้อพิพาทใดให้อนุญาโตตุลาการเป็นผู้ชี้ขาดสินค้าต้องส่งมอบที่ท่าเรือ"


def test_scripts_without_blanks(spark):
    df = spark.createDataFrame([(1, f"运输耗时三十二天。{ZH[:60]}。谁保管原件？"), (2, f"谁保管原件？{ZH[:9]}。{TH}"), (3, "a b. " * 30)], "doc_id long, text string")
    items = spark.createDataFrame([(1, ZH), (2, TH)], "item_id long, text string")
    assert {tuple(r) for r in leakage.found(df, items).collect()} == {(1, 1), (2, 2)}
    got = {r.doc_id: r for r in leakage.without_leaks(df, items, max_share=0.95).collect()}
    assert got[1].text == "运输耗时三十二天。。谁保管原件？" and got[3].removed_chars == 0


def test_removal_leaves_no_second_copy_and_shuffles_nothing(spark):
    own = " ".join(f"w{k}" for k in range(30))
    text = f"Begin. {own.upper()}, and then {own}! End. " + "filler words here " * 40
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (None, text)], "doc_id long, text string")
    items = spark.createDataFrame([(1, own), (2, own + " x y z")], "item_id long, text string")
    out = leakage.without_leaks(df, items)
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[1].text.startswith("Begin. , and then ! End. filler") and rows[2].text is None and not rows[2].dropped and rows[3].text == "" and len(rows) == 3
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert leakage.leaked_spans(df, items).filter("item_id = 1").count() == 2


def test_short_items_count_whole():
    item = [f"w{k}" for k in range(14)]
    a = leakage.Automaton([(1, item), (2, [f"v{k}" for k in range(12)])])
    assert [x[:3] for x in a.passages(["x", *item, "y"])] == [(1, 1, 15)] and a.passages(["x", *item[:13], "y", *(f"v{k}" for k in range(12))]) == []
