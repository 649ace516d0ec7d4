"""Benchmark items that are short, full of slots, without blanks, or in another case."""

from cellsift.llm import decontaminate


def found(spark, items, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r["doc_id"]: r["item_ids"] for r in decontaminate.contamination(docs, bench).collect()}
    clean = {r["doc_id"] for r in decontaminate.drop_contaminated(docs, bench).collect()}
    assert clean == {d for d, x in got.items() if not x}
    return [got[i] for i in range(len(texts))]


def test_items_without_windows(spark):
    items = ["Who wrote Faust?", "12 + 45 = 57, 13 + 46 = 59, 14 + 47 = 61, 15 + 48 = 63", "中国的首都是哪里?", "Anna Bert Carl Dora Emil Fritz Gerd Hans Ida Jan Karl Lea Max Nora Otto", "... ?", "", None]
    texts = ["quiz: who wrote Faust - Goethe", "who wrote Fausto", "see 12 + 45 = 57, 13 + 46 = 59, 14 + 47 = 61, 15 + 48 = 63.", "12 + 45 = 57, 13 + 46 = 59, 14 + 47 = 61, 15 + 48 = 64",
             "问答。中国的首都是哪里?北京。", "中国的首都是北京", "They are Anna, Bert, Carl, Dora, Emil, Fritz, Gerd, Hans, Ida, Jan, Karl, Lea, Max, Nora, Otto.", "... ? what", "", None]
    assert found(spark, items, texts) == [[0], [], [1], [], [2], [], [3], [], [], []]


def test_title_case(spark):
    question = "the old farmer drives his heavy cart along a narrow road and loses one wheel near the bridge"
    assert found(spark, [question], ["Story: " + question.title(), question.title()[:40]]) == [[0], []]


def test_sentences_open_with_names(spark):
    """A renamed person, and a copy whose first word follows a text without a stop."""
    items = ["Tom has 5 apples. Tom buys 3 more. How many does Tom have?", "Which river flows through the old town of Dresden?"]
    texts = ["Exercise. Sam has 7 apples. Sam buys 9 more. How many does Sam have?", "Sam has 7 apples. Ann buys 9 more. How many does Joe have?", "Question 4\nTom has 5 apples. Tom buys 3 more. How many does Tom have?",
             "Geography\nWhich river flows through the old town of Dresden? The Elbe.", "Tom has 5 apples."]
    assert found(spark, items, texts) == [[0], [], [0], [1], []]


def test_few_words_among_numbers(spark):
    item = "row 11 12 13 sum 14 15 mean 16 17 18 19 top 20 21 22"
    assert found(spark, [item], ["Table\n" + item + " end", item.replace("19", "91")]) == [[0], []]


def test_plain_words_read_as_the_general_way_does():
    letters = [chr(c) for c in range(0x21, 0x180) if not chr(c).isspace()] + ["ก", "中", "̇", "Ι"]
    words = [w for c in letters for w in (c, c + ".", c + "a", "A" + c, "ab" + c, c + "b,", "Kg" + c + "!", "(" + c + "x)")] + ["km", "Km.", "USD", "it's", "12kg", "x:", "??"]
    held = decontaminate.Canonical()
    ids = [held.memo[w.encode()] for w in words]
    *kinds, begin, count = held._tables()
    for w, i in zip(words, ids):
        assert tuple(c[i] for c in kinds) == decontaminate._word(w), w
        pieces = [decontaminate._piece_hash(p) for p in decontaminate._PIECE.findall(w.lower())]
        assert held.flat[begin[i] : begin[i] + count[i]].tolist() == pieces, w


def test_words_beyond_the_memo_are_read_anew():
    texts = [f"Tom has {i} red apples{i}, and w{i}o buys {i}kg more.".encode() for i in range(60)]
    small, large = decontaminate.Canonical(20), decontaminate.Canonical()
    for text in texts * 2:
        (a, *x), (b, *y) = small.read([text]), large.read([text])
        assert all((getattr(a, c) == getattr(b, c)).all() for c in ("kind", "value", "opens", "text"))
        assert all((p == q).all() for p, q in zip(x, y))
