import pytest
from pyspark.sql import functions as F

from loomtext.functions import connective_lists as lists
from loomtext.operators import annotate as A
from loomtext.operators import metrics as M

TEXTS = [
    "The dogs run to the house. The house is big and this is it!\nBecause dogs are running, they really bark. And and and.",
    "One sentence only here",
    "word",
    "",
    "This dog sees that. These dogs see this dog. In addition the cat, on the other hand, sleeps so that they can run.\n\nA new paragraph of dogs and cats. Dogs.\nThird one of cats.",
    "loop " * 120,
]


@pytest.fixture(scope="module")
def docs(spark):
    return M.with_segments(A.annotate(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"))).cache()


def nested(docs):
    return {r.doc_id: r.doc for r in docs.select("doc_id", "doc").collect()}


def in_class(t, c):
    noun, adj, adv = t.tag in ("NN", "NNS"), t.tag == "JJ", t.tag == "RB"
    verb = t.tag in ("VBD", "VBG", "VBP", "MD")
    return {
        "all": True,
        "cw": noun or adj or (verb and t.pos != "AUX") or (adv and (t.lemma in ADJ or t.lemma[-2:] == "ly" and t.lemma[:-2] in ADJ)),
        "fw": not (noun or adj or adv or verb) or (verb and t.pos == "AUX") or (adv and not (t.lemma in ADJ or t.lemma[-2:] == "ly" and t.lemma[:-2] in ADJ)),
        "noun": noun,
        "verb": verb and t.pos != "AUX",
        "adj": adj,
        "adv": adv,
        "pronoun": t.tag in ("PRP", "PRP$") or (t.raw in lists.DEMONSTRATIVES and t.dep != "det"),
        "argument": t.tag in ("PRP", "PRP$") or noun,
    }[c]


ADJ = ["real", "then"]


def overlap(segments):
    """Six indices of a list of word lists, counted segment by segment."""
    n = len(segments)
    if n < 2:
        return [0] * 6
    o1 = o2 = b1 = b2 = n1 = n2 = 0
    for i in range(n - 1):
        own, nxt = set(segments[i]), set(segments[i + 1])
        one = len(own & nxt)
        two = 0
        if i <= n - 3:
            two = len(own & (nxt | set(segments[i + 2])))
            n2 += len(own)
        n1, o1, o2, b1, b2 = n1 + len(own), o1 + one, o2 + two, b1 + (one > 0), b2 + (two > 0)
    div = lambda a, b: a / b if b else 0
    return [div(o1, n1), div(o1, n - 1), div(b1, n - 1), div(o2, n2), div(o2, n - 2), div(b2, n - 2)]


def test_overlap_equals_plain_counting(docs):
    got = {r.doc_id: r for r in M.overlap(docs, adjectives=ADJ).collect()}
    for d, paras in nested(docs).items():
        for level in ("sent", "para"):
            segments = [s for p in paras for s in p] if level == "sent" else [[t for s in p for t in s] for p in paras]
            for c in M.CLASSES:
                want = overlap([[t.lemma for t in s if in_class(t, c)] for s in segments])
                names = [f"adjacent_overlap_{w}{k}" for w, k in (("", f"{c}_{level}"), ("", f"{c}_{level}_div_seg"), ("binary_", f"{c}_{level}"), ("2_", f"{c}_{level}"), ("2_", f"{c}_{level}_div_seg"), ("binary_2_", f"{c}_{level}"))]
                assert [got[d][n] for n in names] == pytest.approx(want), (d, c, level)
    assert len(M.overlap(docs).columns) == 109


def test_diversity_equals_plain_counting(docs):
    got = {r.doc_id: r for r in M.diversity(docs, ADJ).collect()}
    div = lambda a, b: a / b if b else 0
    for d, paras in nested(docs).items():
        tokens = [t for p in paras for s in p for t in s]
        for name, c in (("lemma", "all"), ("content", "cw"), ("function", "fw"), ("noun", "noun"), ("verb", "verb"), ("prp", "pronoun"), ("argument", "argument")):
            words = [t.lemma for t in tokens if in_class(t, c)]
            assert got[d][f"{name}_ttr"] == pytest.approx(div(len(set(words)), len(words)))
            if name in ("lemma", "function"):
                windows = [words[i : i + 50] for i in range(len(words) - 49)] if len(words) > 50 else []
                want = sum(len(set(w)) / 50 for w in windows) / len(windows) if windows else div(len(set(words)), len(words))
                assert got[d][f"{name}_mattr"] == pytest.approx(want)
        words = [t.lemma for t in tokens]
        for n, name in ((2, "bigram"), (3, "trigram")):
            grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
            assert got[d][f"{name}_lemma_ttr"] == pytest.approx(div(len(set(grams)), len(grams)))


def test_connectives_equal_plain_counting(docs):
    got = {r.doc_id: r for r in M.connectives(docs).collect()}
    for d, paras in nested(docs).items():
        tokens = [t for p in paras for s in p for t in s]
        text, n = " " + " ".join(t.raw for t in tokens) + " ", len(tokens)
        for name, (phrases, alone, marked) in M.CONNECTIVES.items():
            count = sum(text.count(f" {p} ") for p in phrases) + sum(t.raw in alone for t in tokens) + sum(t.dep == "mark" and t.raw in marked for t in tokens)
            assert got[d][name] == pytest.approx(count / n if n else 0), (d, name)
        linkers = sum(t.raw in lists.SENTENCE_LINKERS for t in tokens) + sum(t.dep == "mark" and t.raw in lists.SENTENCE_LINKERS_CAVEAT[0] for t in tokens)
        assert got[d].sentence_linking == pytest.approx(linkers / n if n else 0)
    assert len(M.connectives(docs).columns) == 26


def test_repeated_phrases_do_not_overlap(spark):
    docs = M.with_segments(A.annotate(spark.createDataFrame([(0, "and and and and")], "doc_id long, text string")))
    assert M.connectives(docs).first().conjunctions == pytest.approx(2 / 4)


def test_givenness_equals_plain_counting(docs):
    got = {r.doc_id: r for r in M.givenness(docs, ADJ).collect()}
    repeated = lambda w: sum(w.count(x) > 1 for x in w)
    for d, paras in nested(docs).items():
        tokens = [t for p in paras for s in p for t in s]
        prp, content = ([t.lemma for t in tokens if in_class(t, c)] for c in ("pronoun", "cw"))
        alone = [t.raw for t in tokens if t.raw in lists.DEMONSTRATIVES and t.dep != "det"]
        nouns = sum(in_class(t, "noun") for t in tokens)
        n = len(tokens)
        assert got[d].pronoun_density == pytest.approx((len(prp) + len(alone)) / n if n else 0)
        assert got[d].pronoun_noun_ratio == pytest.approx((len(prp) + len(alone)) / nouns if nouns else 0)
        assert got[d].repeated_content_and_pronoun_lemmas == pytest.approx((repeated(content) + repeated(prp) + repeated(alone)) / n if n else 0)


def test_short_texts_get_a_status(docs):
    got = {r.doc_id: r for r in M.all_families(docs, ("diversity",)).collect()}
    assert got[2].status == got[3].status == "text too short" and got[2].lemma_ttr is None and got[0].status == "ok"


def test_masked_ngrams_stay_within_sentences(docs):
    grams = {r.ngram for r in M.masked_ngrams(docs.where("doc_id = 0"), "n_bi").collect()}
    assert "x dog" in grams
    plain = {r.ngram for r in M.masked_ngrams(docs.where("doc_id = 0"), "tri").collect()}
    assert "house the house" not in plain and "the house is" in plain


def test_other_annotators_plug_in(spark):
    def one_word_a_token(text):
        return [[[{"raw": w, "lemma": w, "tag": "NN", "pos": "X", "dep": "dep"} for w in text.split()]]]

    docs = M.with_segments(A.annotate_with(spark.createDataFrame([(1, "a b a")], "doc_id long, text string"), one_word_a_token))
    assert M.diversity(docs).first().noun_ttr == pytest.approx(2 / 3)
    assert A.token_table(docs).count() == 3
    assert docs.select(F.size("tokens")).first()[0] == 3
