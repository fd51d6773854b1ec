import pytest

from jobweft.llm.words import Sequences, WordHashes, words


@pytest.mark.parametrize(("text", "want"), [
    ("One<b>Two</b> three_four", ["one", "two", "three", "four"]), ("a&amp;b &lt;c&gt; caf&eacute;", ["a", "b", "c", "café"]), ("zero​width soft­hyphen", ["zerowidth", "softhyphen"]),
    ("Größe 12,5 日本", ["größe", "12", "5", "日本"]), ("", []), (None, []), ("...", [])])
def test_words(text, want):
    assert words(text) == want


def test_sequences_keep_texts_apart():
    h = WordHashes()
    s = Sequences([["a", "b", "c"], ["x"], [], ["a", "b", "c", "d"]], 3, h)
    assert [len(s[i]) for i in range(4)] == [1, 0, 0, 2] and s[0][0] == s[3][0]
    h.limit = 2
    assert Sequences([["a", "b", "c"]], 3, h)[0][0] == s[0][0]
