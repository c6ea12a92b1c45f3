"""Classes of many different contexts: a passage that very many texts share."""

import random

from tijolo.llm import repeats


def test_texts_around_a_common_passage_are_cut_at_its_ends_only(spark, monkeypatch):
    """Parts of a passage are equal in all texts, whatever follows it, and so need no cut into single windows."""
    draw = random.Random(1)
    word = lambda n: "".join(draw.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    passage, count = word(700), 120
    texts = [word(draw.randint(300, 500)) + passage + word(draw.randint(300, 500)) for _ in range(count)]
    made, write = [], repeats.written

    def counted(df, name):
        out = write(df, name)
        if name == "repeat-parts":
            made.append(out.count())
        return out

    monkeypatch.setattr(repeats, "written", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = {r.doc_id: r for r in repeats.remove_repeats(docs, most=20).collect()}
    contexts, parts = made[0], sum(made[1:])
    assert contexts and parts <= 15 * contexts, (contexts, parts)
    for i, text in enumerate(texts):
        at = text.index(passage)
        for spans in (found[i].spans, found[i].shared):
            # a byte more or less where two texts go on with the same letter by chance
            assert len(spans) == 1 and at - 4 <= spans[0].s <= at and at + 700 <= spans[0].e <= at + 704
