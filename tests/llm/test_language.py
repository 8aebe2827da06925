from spanloom.llm import sentences


def test_language_is_told_from_the_whole_text():
    head = "The list of the terms and of the parts to be in the box. " * 80
    body = "Der Vertrag ist nicht von der Firma und wurde von der Bank und das Amt gelesen. " * 400
    assert len(head) > 4000
    for lang in (None, "xx"):
        assert sentences.language(head + body, lang) == "de"
    assert sentences.language(head, None) == "en" and sentences.language(head + body, "en") == "en"
