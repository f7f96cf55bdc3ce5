"""Registered queries over documents: cleaning, selection and the cohesion indices, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.operators import annotate as A
from loomtext.operators import lexicon as L
from loomtext.operators import metrics as M
from loomtext.operators import select as S
from loomtext.operators.corpus_items import corpus_items
from loomtext.plans import cohesion as CO
from loomtext.plans.registry import ORACLES, query, rounded
from loomtext.shared import fresh_dir
from loomtext.sources import io

#: Adjectives of the test lexicon: syllables of the fixture's invented prose.
ADJECTIVES = ["er", "on", "en", "and", "the", "thon", "hand"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", "text")


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.with_segments(A.annotate(texts(spark, sf_dir)))


# --- shared SQL -------------------------------------------------------------------------------------------------

PARAS = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({t}, chr(65279), '', 'g'), '[\t' || chr(160) || ']', ' ', 'g'), ' {{2,}}', ' ', 'g'), '\n(?: ?\n)+', chr(10), 'g'), '\A\n', ''), '\n\z', '')"""
TOKENS = rf"""
paras AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) - 1 AS para FROM (SELECT doc_id, string_split({PARAS.format(t='lower(text)')}, chr(10)) AS ps FROM documents)),
sents AS (SELECT doc_id, para, unnest(ss) AS s, generate_subscripts(ss, 1) AS k FROM (SELECT doc_id, para, list_filter(list_transform(regexp_extract_all(p, '[^.!?]+'), lambda x: regexp_extract_all(x, '[\p{{L}}\p{{N}}]+')), lambda y: len(y) > 0) AS ss FROM paras)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY para, k) - 1 AS sent FROM sents),
words AS (SELECT doc_id, para, sent, unnest(s) AS raw, generate_subscripts(s, 1) - 1 AS place, len(s) AS size FROM numbered),
toks AS (SELECT doc_id, para, sent, place, raw, {A.lemma_sql('raw')} AS lemma, {A.tag_sql('raw').replace('regexp_like', 'regexp_matches')} AS tag, {A.pos_sql('raw')} AS pos, {A.dep_sql('raw', 'place', 'size')} AS dep FROM words),
docs AS (SELECT doc_id, count(raw)::DOUBLE AS n FROM documents LEFT JOIN toks USING (doc_id) GROUP BY doc_id)"""


def with_tokens(sql: str) -> str:
    return f"WITH {TOKENS}\n{sql}"


def zeros(names: list[str], sql: str) -> str:
    """The query's rows, with zeros for documents that it does not give: those without words."""
    return f"SELECT d.doc_id, {', '.join(f'coalesce("{n}", 0) AS "{n}"' for n in names)} FROM documents AS d LEFT JOIN ({sql}) AS found USING (doc_id)"


def div(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN 0 ELSE ({a})::DOUBLE / ({b}) END"


# --- cleaning and counts ----------------------------------------------------------------------------------------


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(text, '[ \t' || chr(160) || ']+', ' ', 'g'), ' ([.,;!?])', '\1', 'g') AS text FROM documents""")
def clean_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.clean_spaces(F.col("text")).alias("text"))


CORPUS = "CASE doc_id % 5 WHEN 0 THEN 'simple_wiki' WHEN 1 THEN 'bnc_spoken' WHEN 2 THEN 'childes' WHEN 3 THEN 'open_subtitles' ELSE 'gutenberg' END"


@query(rf"""SELECT doc_id, CASE c WHEN 'simple_wiki' THEN replace(t, chr(10) || chr(10), '') WHEN 'bnc_spoken' THEN replace(s, chr(10) || chr(10), '') WHEN 'childes' THEN s WHEN 'open_subtitles' THEN regexp_replace(t, '(?im)^.*subtitle.*$\n', '', 'g') ELSE t END AS text
FROM (SELECT doc_id, {CORPUS} AS c, text || chr(10) || 'Subtitles by x' || chr(10) || chr(10) || 'end' AS t, regexp_replace(regexp_replace(text || chr(10) || 'Subtitles by x' || chr(10) || chr(10) || 'end', '[ \t' || chr(160) || ']+', ' ', 'g'), ' ([.,;!?])', '\1', 'g') AS s FROM documents)""")
def clean_corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.concat("text", F.lit("\nSubtitles by x\n\nend"))
    return documents(spark, sf_dir).select("doc_id", T.clean_corpus(marked, F.expr(CORPUS)).alias("text"))


@query(rf"""SELECT doc_id, len(ps)::BIGINT AS n, ps[1] AS first FROM (SELECT doc_id, string_split({PARAS.format(t='text')}, chr(10)) AS ps FROM documents)""")
def para_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.paragraphs(F.col("text")).alias("ps")).select("doc_id", F.size("ps").cast("long").alias("n"), F.get("ps", F.lit(0)).alias("first"))


@query(r"""SELECT doc_id, regexp_replace(text, '[^\p{L}\p{N} ]', '', 'g') AS text FROM documents""")
def alnum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.alnum_only(F.col("text")).alias("text"))


@query(r"""SELECT doc_id, array_to_string(regexp_extract_all(text, '\S+'), ' ') AS text FROM documents""")
def squeeze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.squeeze(F.col("text")).alias("text"))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '\S+'))::BIGINT AS n_words, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'))::BIGINT AS n_tokens FROM documents""")
def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.word_count(F.col("text")).alias("n_words"), T.token_count(F.col("text")).alias("n_tokens"))


@query(r"""SELECT doc_id, n FROM (SELECT doc_id, len(regexp_extract_all(text, '\S+'))::BIGINT AS n FROM documents) WHERE n BETWEEN 20 AND 400""")
def word_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.word_count(F.col("text")).alias("n")).where(F.col("n").between(20, 400))


@query("SELECT doc_id, n_chars FROM documents WHERE length(text) > 200")
def char_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).where(F.length("text") > 200).select("doc_id", "n_chars")


@query(r"""SELECT doc_id, n, running::BIGINT AS running FROM (SELECT doc_id, n, sum(n) OVER (ORDER BY n DESC, doc_id ROWS UNBOUNDED PRECEDING) AS running FROM (SELECT doc_id, len(regexp_extract_all(text, '\S+'))::BIGINT AS n FROM documents)) WHERE running <= 100000""")
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = documents(spark, sf_dir).select("doc_id", T.word_count(F.col("text")).alias("n"))
    return S.token_budget(sized, "n", 100_000).select("doc_id", "n", "running")


@query("""SELECT doc_id, CASE WHEN r < floor(0.8 * n) THEN 'train' WHEN r < floor(0.9 * n) THEN 'validation' ELSE 'test' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r, count(*) OVER () AS n FROM documents)""")
def ordinal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.ordinal_split(documents(spark, sf_dir).select("doc_id"), "doc_id")


@query("""SELECT doc_id, least(r // (n // 7), 6)::BIGINT AS iteration FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r, count(*) OVER () AS n FROM documents)""")
def iteration_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.iteration_ranges(documents(spark, sf_dir).select("doc_id"), "doc_id", 7)


IDS_SQL = r"""SELECT doc_id, list_transform(regexp_extract_all(text, '\S+'), lambda w: length(w)::BIGINT) AS ids FROM documents"""


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.transform(T.words(F.col("text")), lambda w: F.length(w).cast("long")).alias("ids"))


@query(f"""SELECT doc_id, k, len(c)::BIGINT AS n, coalesce(list_sum(c), 0)::BIGINT AS total FROM (SELECT doc_id, k, ids[k * (len(ids) // 4) + 1 : CASE WHEN k = 3 THEN len(ids) ELSE (k + 1) * (len(ids) // 4) END] AS c FROM (SELECT doc_id, ids, unnest(range(0, 4)) AS k FROM ({IDS_SQL})))""")
def id_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _ids(spark, sf_dir).select("doc_id", F.posexplode(S.id_chunks(F.col("ids"), 4)).alias("k", "c"))
    return chunks.select("doc_id", F.col("k").cast("long").alias("k"), F.size("c").cast("long").alias("n"), F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query(f"""SELECT doc_id, i, coalesce(list_sum(ids[i * 16 + 1 : i * 16 + 8]), 0)::BIGINT AS context, coalesce(list_sum(ids[i * 16 + 9 : i * 16 + 16]), 0)::BIGINT AS completion FROM (SELECT doc_id, ids, unnest(range(0, len(ids) // 16)) AS i FROM ({IDS_SQL}))""")
def datapoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _ids(spark, sf_dir).select("doc_id", F.posexplode(S.datapoints(F.col("ids"), 16, 0.5)).alias("i", "d"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return each.select("doc_id", F.col("i").cast("long").alias("i"), total("d.context").alias("context"), total("d.completion").alias("completion"))


@query(r"""SELECT word, count(*)::BIGINT AS n FROM (SELECT unnest(CASE WHEN regexp_matches(w, '^.+[.,!?;\])>]$') THEN [left(w, -1), right(w, 1)] ELSE [w] END) AS word FROM (SELECT unnest(regexp_extract_all(text, '\S+')) AS w FROM documents)) GROUP BY word""")
def punctuation_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = documents(spark, sf_dir).select(F.explode(T.words(F.col("text"))).alias("w"))
    parts = F.when(F.col("w").rlike(r"^.+[.,!?;\])>]$"), F.array(F.expr("left(w, length(w) - 1)"), F.expr("right(w, 1)"))).otherwise(F.array("w"))
    return w.select(F.explode(parts).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query(f"""SELECT id AS token, count(*)::BIGINT AS n FROM (SELECT unnest(CASE WHEN list_position(ids, 7) > 0 THEN ids[1 : list_position(ids, 7) - 1] ELSE ids END) AS id FROM ({IDS_SQL})) GROUP BY id""")
def token_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomtext.operators.signal import until_pad

    return _ids(spark, sf_dir).select(F.explode(until_pad(F.col("ids"), 7)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query(f"""SELECT DISTINCT unnest(ids) AS token FROM ({IDS_SQL})""")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(spark, sf_dir).select(F.explode("ids").alias("token")).distinct()


# --- cohesion indices -------------------------------------------------------------------------------------------

C = M.class_conditions(ADJECTIVES)
NAMES = {"lemma": "all", "content": "cw", "function": "fw", "noun": "noun", "verb": "verb", "adj": "adj", "adv": "adv", "prp": "pronoun", "argument": "argument"}


def _ttr(cond: str) -> str:
    return div(f"count(DISTINCT lemma) FILTER (WHERE {cond})", f"count(*) FILTER (WHERE {cond})")


def _mattr(name: str) -> str:
    return f"CASE WHEN len({name}) <= 50 THEN {div(f'len(list_distinct({name}))', f'len({name})')} ELSE list_avg(list_transform(range(1, len({name}) - 48), lambda i: len(list_distinct(list_slice({name}, i, i + 49))) / 50.0)) END"


def _ngram(n: int) -> str:
    return f"list_transform(range(1, greatest(len(l) - {n - 2}, 1)), lambda i: array_to_string(list_slice(l, i, i + {n - 1}), ' '))"


DIVERSITY = ", ".join(f"{_ttr(C[c])} AS {n}_ttr" for n, c in NAMES.items())


DIVERSE = [*[f"{n}_ttr" for n in NAMES], "lexical_density_tokens", "lexical_density_types"]


@query(
    zeros(
        DIVERSE,
        with_tokens(f"""SELECT doc_id, {', '.join(f'round({n}, 6) AS {n}' for n in DIVERSE)}
FROM (SELECT doc_id, {DIVERSITY}, {div(f"count(*) FILTER (WHERE {C['cw']})", "count(*)")} AS lexical_density_tokens, {div(f"count(DISTINCT lemma) FILTER (WHERE {C['cw']})", "count(DISTINCT lemma)")} AS lexical_density_types FROM toks AS t GROUP BY doc_id)"""),
    )
)
def diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.diversity(texts(spark, sf_dir), ADJECTIVES).select("doc_id", *DIVERSE))


MOVING = ["lemma_mattr", "function_mattr", "bigram_lemma_ttr", "trigram_lemma_ttr"]


@query(
    zeros(
        MOVING,
        with_tokens(f"""SELECT doc_id, round({_mattr('l')}, 6) AS lemma_mattr, round({_mattr('f')}, 6) AS function_mattr, round({div(f'len(list_distinct({_ngram(2)}))', f'len({_ngram(2)})')}, 6) AS bigram_lemma_ttr, round({div(f'len(list_distinct({_ngram(3)}))', f'len({_ngram(3)})')}, 6) AS trigram_lemma_ttr
FROM (SELECT doc_id, list(lemma ORDER BY sent, place) AS l, coalesce(list(lemma ORDER BY sent, place) FILTER (WHERE {C['fw']}), []) AS f FROM toks AS t GROUP BY doc_id)"""),
    )
)
def mattr_and_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.diversity(texts(spark, sf_dir), ADJECTIVES).select("doc_id", *MOVING))


def _overlap_sql(level: str) -> str:
    seg = "sent" if level == "sent" else "para"
    n = "SELECT doc_id, count(*) AS n FROM numbered GROUP BY doc_id" if level == "sent" else "SELECT doc_id, count(*) AS n FROM paras GROUP BY doc_id"
    classes = " UNION ALL ".join(f"SELECT DISTINCT doc_id, {seg} AS seg, '{c}' AS class, lemma FROM toks AS t WHERE {C[c]}" for c in M.CLASSES)
    pivot, names = [], []
    for c in M.CLASSES:
        for w in ("", "2_"):
            o, b, d, less = ("o2", "b2", "n2", 2) if w else ("o1", "b1", "n1", 1)
            names += [f"adjacent_overlap_{w}{c}_{level}", f"adjacent_overlap_{w}{c}_{level}_div_seg", f"adjacent_overlap_binary_{w}{c}_{level}"]
            pick = lambda x, c=c: f"coalesce(max({x}) FILTER (WHERE class = '{c}'), 0)"
            pivot += [
                f"round({div(pick(o), pick(d))}, 6) AS adjacent_overlap_{w}{c}_{level}",
                f"round({div(pick(o), f'greatest(any_value(n) - {less}, 0)')}, 6) AS adjacent_overlap_{w}{c}_{level}_div_seg",
                f"round({div(pick(b), f'greatest(any_value(n) - {less}, 0)')}, 6) AS adjacent_overlap_binary_{w}{c}_{level}",
            ]
    return zeros(names, with_tokens(f"""SELECT doc_id, {', '.join(pivot)} FROM (
SELECT c.doc_id, c.n, s.class, s.n1, s.n2, s.o1, s.o2, s.b1, s.b2 FROM ({n}) AS c LEFT JOIN (
  SELECT doc_id, class, sum(n1) AS n1, sum(n2) AS n2, sum(o1) AS o1, sum(o2) AS o2, sum((o1 > 0)::INT) AS b1, sum((o2 > 0)::INT) AS b2 FROM (
    SELECT a.doc_id, a.class, a.seg, count(DISTINCT a.lemma) AS n1, CASE WHEN a.seg <= any_value(n) - 3 THEN count(DISTINCT a.lemma) ELSE 0 END AS n2, count(DISTINCT CASE WHEN b.seg = a.seg + 1 THEN a.lemma END) AS o1, CASE WHEN a.seg <= any_value(n) - 3 THEN count(DISTINCT b.lemma) ELSE 0 END AS o2
    FROM ({classes}) AS a JOIN ({n}) AS k ON k.doc_id = a.doc_id LEFT JOIN ({classes}) AS b ON a.doc_id = b.doc_id AND a.class = b.class AND a.lemma = b.lemma AND b.seg IN (a.seg + 1, a.seg + 2)
    WHERE a.seg <= k.n - 2 GROUP BY a.doc_id, a.class, a.seg) GROUP BY doc_id, class) AS s ON c.doc_id = s.doc_id) GROUP BY doc_id"""))


@query(_overlap_sql("sent"))
def overlap_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.overlap(texts(spark, sf_dir), ("sent",), adjectives=ADJECTIVES))


@query(_overlap_sql("para"))
def overlap_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.overlap(texts(spark, sf_dir), ("para",), adjectives=ADJECTIVES))


def _connectives_sql() -> str:
    counts = {name: f"count(*) FILTER (WHERE {cond})" for name, cond in M.token_conditions().items()}
    agg = ", ".join(f"{sql} AS c_{name}" for name, sql in counts.items())
    out = [f"round(c_{name} / n, 6) AS {name}" for name in ("lexical_subordinators", "attended_demonstratives", "unattended_demonstratives")]
    out.append("round((c_sentence_linking + c_sentence_linking_marked) / n, 6) AS sentence_linking")
    for name, (phrases, alone, _) in M.CONNECTIVES.items():
        count = " + ".join(f"len(string_split(s, ' {p} ')) - 1" for p in phrases)
        out.append(f"round(({count}{f' + c_{name} + c_{name}_marked' if alone else ''}) / n, 6) AS {name}")
    names = [*[n for n in counts if not n.endswith("_marked") and n not in M.CONNECTIVES], *M.CONNECTIVES]
    return zeros(names, with_tokens(f"SELECT doc_id, {', '.join(out)} FROM (SELECT doc_id, count(*)::DOUBLE AS n, ' ' || string_agg(raw, ' ' ORDER BY sent, place) || ' ' AS s, {agg} FROM toks AS t GROUP BY doc_id)"))


@query(_connectives_sql())
def connectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.connectives(texts(spark, sf_dir)))


PHRASES = {"of_the": ["of the", "in the"], "and_the": ["and the", "to the", "the"]}


@query(zeros(list(PHRASES), with_tokens("SELECT doc_id, " + ", ".join(f"round(sum({' + '.join(f'''len(string_split(s, ' {p} ')) - 1''' for p in ps)}) / sum(k), 6) AS {n}" for n, ps in PHRASES.items()) + " FROM (SELECT doc_id, sent, count(*)::DOUBLE AS k, ' ' || string_agg(raw, ' ' ORDER BY place) || ' ' AS s FROM toks GROUP BY doc_id, sent) GROUP BY doc_id")))
def phrases_per_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.phrases_per_sentence(texts(spark, sf_dir), PHRASES))


def _repeat(cond: str, field: str) -> str:
    return f"SELECT doc_id, sum(CASE WHEN k > 1 THEN k ELSE 0 END) AS r, sum(k) AS n FROM (SELECT doc_id, {field} AS w, count(*) AS k FROM toks AS t WHERE {cond} GROUP BY doc_id, {field}) GROUP BY doc_id"


@query(
    with_tokens(f"""SELECT docs.doc_id, round({div('coalesce(p.n, 0) + coalesce(u.n, 0)', 'docs.n')}, 6) AS pronoun_density, round({div('coalesce(p.n, 0) + coalesce(u.n, 0)', 'coalesce(x.n, 0)')}, 6) AS pronoun_noun_ratio, round({div('coalesce(c.r, 0)', 'docs.n')}, 6) AS repeated_content_lemmas, round({div('coalesce(c.r, 0) + coalesce(p.r, 0) + coalesce(u.r, 0)', 'docs.n')}, 6) AS repeated_content_and_pronoun_lemmas
FROM docs LEFT JOIN ({_repeat(C['cw'], 'lemma')}) AS c USING (doc_id) LEFT JOIN ({_repeat(C['pronoun'], 'lemma')}) AS p USING (doc_id) LEFT JOIN ({_repeat(M.UNATTENDED, 'raw')}) AS u USING (doc_id) LEFT JOIN ({_repeat(C['noun'], 'lemma')}) AS x USING (doc_id)""")
)
def givenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.givenness(texts(spark, sf_dir), ADJECTIVES))


SINGLE = {"words": ("true", "raw"), "lemmas": ("true", "lemma"), "content_lemmas": (C["cw"], "lemma")}


@query(with_tokens(f"""SELECT docs.doc_id, {', '.join(f"round({div(f'coalesce({n}.r, 0)', 'docs.n')}, 6) AS repeated_{n}_givenness, round({div(f'coalesce({n}.n - {n}.r, 0)', 'docs.n')}, 6) AS single_{n}_givenness" for n in SINGLE)} FROM docs {' '.join(f'LEFT JOIN ({_repeat(*own)}) AS {n} USING (doc_id)' for n, own in SINGLE.items())}"""))
def single_givenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.single_givenness(texts(spark, sf_dir), ADJECTIVES))


@query(zeros(["nwords", "nsents", "nparas", "ntypes"], with_tokens("SELECT docs.doc_id, n::BIGINT AS nwords, nsents, nparas, ntypes FROM docs LEFT JOIN (SELECT doc_id, count(*)::BIGINT AS nsents FROM sents GROUP BY doc_id) USING (doc_id) LEFT JOIN (SELECT doc_id, count(*)::BIGINT AS nparas FROM paras GROUP BY doc_id) USING (doc_id) LEFT JOIN (SELECT doc_id, count(DISTINCT raw)::BIGINT AS ntypes FROM toks GROUP BY doc_id) USING (doc_id)")))
def basic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.basic_counts(texts(spark, sf_dir))


TAGS = {None: "true", M.I.NOUN_TAGS: M.NOUNS, M.I.ADJECTIVE_TAGS: M.ADJECTIVES, M.I.VERB_TAGS: M.VERBS, M.I.VERB_TAGS + M.I.NOUN_TAGS: M.VERBS[:-1] + "," + M.NOUNS[1:], M.I.ADJECTIVE_TAGS + M.I.NOUN_TAGS: M.ADJECTIVES[:-1] + "," + M.NOUNS[1:]}


def _items_sql(within: str, families: tuple[str, ...]) -> str:
    """(doc_id, family, item, k) of the tokens; n-grams within a sentence or a document."""
    parts = []
    for family in families:
        mask, _, size = family.rpartition("_")
        tags = M.I.UNIGRAMS[family] if family in M.I.UNIGRAMS else M.I.MASKED[mask]
        cond = "true" if tags is None else f"tag IN {TAGS[tags]}"
        if family in M.I.UNIGRAMS:
            parts.append(f"SELECT doc_id, '{family}' AS family, lemma AS item, count(*)::BIGINT AS k FROM toks WHERE {cond} GROUP BY doc_id, lemma")
        else:
            unit = "doc_id, sent" if within == "sent" else "doc_id"
            gram = " || ' ' || ".join(["m", *[f"lead(m, {i}) OVER (PARTITION BY {unit} ORDER BY sent, place)" for i in range(1, M.I.SIZES[size])]])
            parts.append(f"SELECT doc_id, '{family}' AS family, item, count(*)::BIGINT AS k FROM (SELECT doc_id, {gram} AS item FROM (SELECT doc_id, sent, place, CASE WHEN {cond} THEN lemma ELSE 'x' END AS m FROM toks)) WHERE item IS NOT NULL GROUP BY doc_id, item")
    return " UNION ALL ".join(parts)


@query(with_tokens("SELECT doc_id, ngram, count(*)::BIGINT AS count FROM (SELECT doc_id, m || ' ' || lead(m) OVER (PARTITION BY doc_id, sent ORDER BY place) AS ngram FROM (SELECT *, CASE WHEN tag IN " + M.NOUNS + " THEN lemma ELSE 'x' END AS m FROM toks)) WHERE ngram IS NOT NULL GROUP BY doc_id, ngram"))
def masked_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.masked_ngrams(texts(spark, sf_dir), "n_bi")


@query(with_tokens(f"SELECT family, item, sum(k)::BIGINT AS k, count(*)::BIGINT AS n_docs FROM ({_items_sql('sent', M.I.NGRAMS)}) GROUP BY family, item"))
def masked_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 18 n-gram families, added up over the corpus."""
    return corpus_items(texts(spark, sf_dir))


@query(with_tokens("SELECT doc_id, para::BIGINT AS para, sent::BIGINT AS sent, place::BIGINT AS place, raw, lemma, tag, pos, dep FROM (SELECT *, sent - min(sent) OVER (PARTITION BY doc_id, para) AS s FROM toks)").replace("sent::BIGINT", "s::BIGINT"))
def token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = A.token_table(A.annotate(texts(spark, sf_dir)))
    return long.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("para", "sent", "place")], "raw", "lemma", "tag", "pos", "dep")


# --- lexicons ---------------------------------------------------------------------------------------------------

AOA_SQL = r"""lex AS (SELECT word, (length(word) + ascii(word) % 7)::DOUBLE AS value FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark))"""


def _aoa(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    return words.select("word", (F.length("word") + F.ascii("word") % 7).cast("double").alias("value"), F.lit(1).alias("line"))


@query(rf"""WITH {AOA_SQL}, w AS (SELECT doc_id, unnest(string_split(regexp_replace(lower(text), '[^\p{{L}}\p{{N}} ]', '', 'g'), ' ')) AS word FROM documents),
b AS (SELECT min(value) AS lo, max(value) AS hi FROM lex)
SELECT d.doc_id, round(CASE WHEN s > 0 THEN (m - lo) / (hi - lo) END, 6) AS score FROM (SELECT DISTINCT doc_id FROM w) AS d LEFT JOIN (SELECT doc_id, sum(value) AS s, avg(value) AS m FROM w JOIN lex USING (word) GROUP BY doc_id) USING (doc_id), b""")
def lexicon_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = texts(spark, sf_dir).select("doc_id", F.explode(F.split(T.alnum_only(F.lower("text")), " ")).alias("word"))
    return rounded(L.normalised_mean(words, _aoa(spark, sf_dir)))


SYN_SQL = "syn AS (SELECT word, [reverse(word), left(word, 3), word] AS syns FROM (SELECT DISTINCT lemma AS word FROM toks WHERE length(lemma) BETWEEN 4 AND 8))"
SYN_CLASSES = {"noun": M.I.NOUN_TAGS, "verb": M.I.VERB_TAGS}


def _synonyms(words: DataFrame) -> DataFrame:
    return _entries(words.select("word").distinct())


def _entries(words: DataFrame) -> DataFrame:
    return words.where(F.length("word").between(4, 8)).select("word", F.array(F.reverse("word"), F.left("word", F.lit(3)), F.col("word")).alias("syns"))


def _synonym_sql(level: str, c: str) -> str:
    segments = "numbered" if level == "sent" else "paras"
    return f"""SELECT c.doc_id, round(CASE WHEN c.n < 2 THEN 0 ELSE coalesce(k, 0) / (c.n - 1)::DOUBLE END, 6) AS syn_overlap_{level}_{c} FROM (SELECT doc_id, count({level}) AS n FROM documents LEFT JOIN {segments} USING (doc_id) GROUP BY doc_id) AS c LEFT JOIN (
SELECT a.doc_id, count(*) AS k FROM (SELECT DISTINCT doc_id, {level}, lemma FROM toks AS t WHERE {C[c]}) AS a JOIN (SELECT doc_id, {level}, list_distinct(coalesce(syns, [lemma])) AS syns FROM toks AS t LEFT JOIN syn ON syn.word = t.lemma WHERE {C[c]}) AS b ON a.doc_id = b.doc_id AND b.{level} = a.{level} + 1 AND list_contains(b.syns, a.lemma) GROUP BY a.doc_id) AS f USING (doc_id)"""


@query("SELECT * FROM " + " JOIN ".join(f"({with_tokens(_synonym_sql(level, c)).replace('SELECT c.doc_id', f', {SYN_SQL} SELECT c.doc_id', 1)}) AS {level}_{c}{' USING (doc_id)' if (level, c) != ('sent', 'noun') else ''}" for level in ("sent", "para") for c in SYN_CLASSES))
def synonym_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four synonym indices: sentences and paragraphs, nouns and verbs."""
    docs = texts(spark, sf_dir)
    return rounded(CO.synonym_indices(docs, _synonyms(M.I.segment_words(docs, "doc"))))


REF_SQL = "ref AS (SELECT lower(w) AS item, count(*) * 1000000.0::DOUBLE / sum(count(*)) OVER () AS per_million FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark) GROUP BY lower(w))"


def _reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("item")).groupBy("item").count()
    total = counts.agg(F.sum("count")).first()[0] or 1
    return counts.select("item", (F.col("count") * 1_000_000.0 / float(total)).alias("per_million"))


@query(
    with_tokens("""SELECT doc_id, item, round(diff, 4) AS diff, round(tf, 6) AS tf, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY diff DESC, tf DESC, item) AS rank FROM (
SELECT c.doc_id, c.lemma AS item, c.types, c.n / c.total::DOUBLE AS tf, c.n, CASE WHEN per_million IS NULL THEN 1000000.0 ELSE (c.n / c.total::DOUBLE - per_million / 1000000) * 100 / (per_million / 1000000) END AS diff
FROM (SELECT doc_id, lemma, count(*) AS n, sum(count(*)) OVER (PARTITION BY doc_id) AS total, count(*) OVER (PARTITION BY doc_id) AS types FROM toks GROUP BY doc_id, lemma) AS c LEFT JOIN ref ON ref.item = c.lemma WHERE c.n >= 2)) WHERE rank <= floor(types * 0.1)""").replace("\nSELECT doc_id, item", f", {REF_SQL}\nSELECT doc_id, item")
)
def keyness(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.keyness(M.I.items(texts(spark, sf_dir), ("uni",)), _reference(spark, sf_dir))
    return found.select("doc_id", "item", F.round("diff", 4).alias("diff"), F.round("tf", 6).alias("tf"), F.col("rank").cast("long").alias("rank"))


@query(
    with_tokens("""SELECT doc_id, round(count(*) FILTER (WHERE k) / count(*)::DOUBLE, 6) AS share, round(CASE WHEN count(*) FILTER (WHERE NOT k) = 0 THEN 0 ELSE count(*) FILTER (WHERE k) / (count(*) FILTER (WHERE NOT k))::DOUBLE END, 6) AS odds
FROM (SELECT doc_id, lemma IN (SELECT item FROM ref) AS k FROM toks) GROUP BY doc_id""").replace("\nSELECT doc_id, round", f", {REF_SQL}\nSELECT doc_id, round")
)
def keyword_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = M.I.segment_words(texts(spark, sf_dir), "doc").select("doc_id", "word", "k")
    own = words.join(_reference(spark, sf_dir).select(F.col("item").alias("word")), "word", "left_semi")
    return rounded(L.keyword_share(words, own))


def _family_reference(docs: DataFrame) -> DataFrame:
    """A frequency for two of three items, by their letters; of the items that stand twice in some document, as no other is looked up."""
    known = M.I.items(docs, least=2).where((F.length("item") + F.ascii("item")) % 3 > 0)
    return known.select("family", F.lower("item").alias("item"), (F.length("item") * 40.0 + F.ascii("item")).alias("per_million")).distinct()


SHARES_SQL = with_tokens(f"""SELECT d.doc_id, {', '.join(f"round(coalesce(max(share) FILTER (WHERE family = '{f}'), 0), 6) AS {f}_keywords_percentage" for f in M.I.ITEM_FAMILIES)} FROM documents AS d LEFT JOIN (
SELECT t.doc_id, t.family, sum(CASE WHEN s.item IS NOT NULL THEN t.k ELSE 0 END) / sum(t.k)::DOUBLE AS share FROM ({_items_sql('doc', M.I.ITEM_FAMILIES)}) AS t LEFT JOIN keys_ AS s ON s.doc_id = t.doc_id + 1 AND s.family = t.family AND s.item = t.item GROUP BY t.doc_id, t.family) USING (doc_id) GROUP BY d.doc_id""").replace("\nSELECT d.doc_id", f""", own AS ({_items_sql('sent', M.I.ITEM_FAMILIES)}),
ref AS (SELECT DISTINCT family, lower(item) AS item, length(item) * 40.0 + ascii(item) AS per_million FROM own WHERE (length(item) + ascii(item)) % 3 > 0),
keys_ AS (SELECT doc_id, family, item FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, family ORDER BY diff DESC, tf DESC, item) AS rank FROM (
SELECT c.doc_id, c.family, c.item, c.types, c.k / c.total::DOUBLE AS tf, CASE WHEN per_million IS NULL THEN 1000000.0 ELSE (c.k / c.total::DOUBLE - per_million / 1000000) * 100 / (per_million / 1000000) END AS diff
FROM (SELECT *, sum(k) OVER (PARTITION BY doc_id, family) AS total, count(*) OVER (PARTITION BY doc_id, family) AS types FROM own) AS c LEFT JOIN ref ON ref.item = lower(c.item) AND ref.family = c.family WHERE c.k >= 2)) WHERE rank <= floor(types * 0.1) AND item NOT IN ('x x', 'x x x', 'x x x x'))
SELECT d.doc_id""", 1)


@query(SHARES_SQL)
def source_keyword_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 23 keyword shares of each document, its source being the next one: of the document's items those that are keywords
    of the source."""
    docs = texts(spark, sf_dir)
    return rounded(CO.source_keywords(docs, next_texts(docs), _family_reference(docs)))


def next_texts(docs: DataFrame) -> DataFrame:
    return docs.withColumn("doc_id", F.transform("doc_id", lambda x: x - 1) if "flat" in docs.columns else F.col("doc_id") - 1)


VEC_SQL = "vec AS (SELECT word, embedding AS v FROM (SELECT word, row_number() OVER (ORDER BY n DESC, word) - 1 AS vec_id FROM (SELECT lemma AS word, count(*) AS n FROM toks GROUP BY lemma)) JOIN embeddings USING (vec_id))"


def _vectors(spark: SparkSession, sf_dir: str, counts: DataFrame) -> DataFrame:
    """The word vectors of the fixture: the words of the corpus by frequency get the vectors in the order of their ids. Words are
    counted once, and those too rare for any id are not sorted."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    last = vectors.agg(F.max("vec_id")).first()[0]
    folder = fresh_dir(spark, "words")
    counts = io.save_table(counts, f"{folder}/counts")
    wanted, least = (-1 if last is None else last) + 1, None
    for n, times in sorted(map(tuple, counts.groupBy("n").count().collect()), reverse=True):  # a row a frequency
        if wanted <= 0:
            break
        wanted, least = wanted - times, n
    known = counts.where("false") if least is None else counts.where(F.col("n") >= least)
    ranked = S.row_index(known, F.col("n").desc(), F.col("word"), name="vec_id")
    return io.save_table(ranked.join(vectors, "vec_id").select("word", F.col("embedding").cast("array<double>").alias("vec")), f"{folder}/vectors")


def corpus_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = M.I.segment_words(texts(spark, sf_dir), "doc").groupBy("word").agg(F.sum("k").alias("n"))
    return _vectors(spark, sf_dir, counts)


def _similar(spark: SparkSession, sf_dir: str, level: str) -> DataFrame:
    found = CO.vector_indices(texts(spark, sf_dir), corpus_vectors(spark, sf_dir), ("lsa", "lda"), dims=64, levels=(level,))
    return rounded(found, 4)


def _similar_sql(kinds: list[tuple[str, int, str]], level: str) -> str:
    values = {"cosine": COSINE, "divergence": DIVERGENCE}
    segments = "numbered" if level == "sent" else "paras"
    each = [
        f"""(SELECT c.doc_id, round(coalesce(avg({values[kind]}), 0), 4) AS {name} FROM documents AS c LEFT JOIN (
SELECT a.doc_id, a.a AS a, {'b.a' if width == 1 else 'list_transform(range(1, 65), lambda i: b.a[i] + d.a[i])'} AS b, a.k AS n1, {'b.k' if width == 1 else 'b.k + d.k'} AS n2 FROM full_ AS a JOIN full_ AS b ON a.doc_id = b.doc_id AND b.seg = a.seg + 1 {'' if width == 1 else 'JOIN full_ AS d ON a.doc_id = d.doc_id AND d.seg = a.seg + 2'}) AS p USING (doc_id) GROUP BY c.doc_id) AS q{i}"""
        for i, (name, width, kind) in enumerate(kinds)
    ]
    joined = each[0] + "".join(f" JOIN {e} USING (doc_id)" for e in each[1:])
    return with_tokens(f"""SELECT doc_id, {', '.join(name for name, _, _ in kinds)} FROM {joined}""").replace(
        "\nSELECT doc_id",
        f""", {VEC_SQL},
sums AS (SELECT doc_id, {level} AS seg, count(*) AS k, {', '.join(f'sum(v[{i}]::DOUBLE) AS s{i}' for i in range(1, 65))} FROM toks JOIN vec ON vec.word = toks.lemma GROUP BY doc_id, {level}),
full_ AS (SELECT n.doc_id, n.{level} AS seg, coalesce(sums.k, 0) AS k, [{', '.join(f'coalesce(s{i}, 0)' for i in range(1, 65))}] AS a FROM {segments} AS n LEFT JOIN sums ON sums.doc_id = n.doc_id AND sums.seg = n.{level})
SELECT doc_id""",
        1,
    )


COSINE = "CASE WHEN list_dot_product(a, a) * list_dot_product(b, b) > 0 THEN list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))) END"
_A = "CASE WHEN n1 = 0 THEN 0.0 ELSE n1 / list_sum(list_transform(a, lambda x: abs(x))) END"
_B = "CASE WHEN n2 = 0 THEN 0.0 ELSE n2 / list_sum(list_transform(b, lambda x: abs(x))) END"
_S = "1 - 0.5 * 2016 * ({x} + {y})"
_X = f"CASE WHEN ({_A}) = 0 THEN 0 ELSE ({_A}) * log2(2 * ({_A}) / (({_A}) + ({_B}))) END"
_Y = f"CASE WHEN ({_B}) = 0 THEN 0 ELSE ({_B}) * log2(2 * ({_B}) / (({_A}) + ({_B}))) END"
DIVERGENCE = f"CASE WHEN p.doc_id IS NOT NULL AND ({_S.format(x=_X, y=_Y)}) >= 0 THEN {_S.format(x=_X, y=_Y)} END"


VECTOR_KINDS = {level: [(f"{space}_{width}_all_{level}", width, "divergence" if space == "lda" else "cosine") for space in ("lsa", "lda") for width in (1, 2)] for level in ("sent", "para")}


@query(_similar_sql(VECTOR_KINDS["sent"], "sent"))
def vector_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums and topics of adjacent sentences, one and two on; word2vec is lsa with other vectors."""
    return _similar(spark, sf_dir, "sent")


@query(_similar_sql(VECTOR_KINDS["para"], "para"))
def vector_similarity_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _similar(spark, sf_dir, "para")


@query(r"""SELECT word, least(count(*), 512)::BIGINT AS n FROM (SELECT DISTINCT doc_id, unnest(string_split(text, ' ')) AS word FROM documents) WHERE word IN ('the', 'of', 'and', 'thing') GROUP BY word""")
def word_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sentences each word is given; which of more than 512 is a matter of hashes."""
    targets = spark.createDataFrame([("the",), ("of",), ("and",), ("thing",)], "word string")
    sentences = documents(spark, sf_dir).select(F.col("doc_id").alias("sentence_id"), "text")
    return L.contexts(targets, sentences).groupBy("word").agg(F.count("*").alias("n"))


SOURCE_SQL = with_tokens(f"""SELECT d.doc_id, round({COSINE}, 4) AS source_similarity_lsa, round({DIVERGENCE}, 4) AS source_similarity_lda FROM documents AS d LEFT JOIN (SELECT x.doc_id, x.a AS a, y.a AS b, x.k AS n1, y.k AS n2 FROM of_ AS x JOIN of_ AS y ON y.doc_id = x.doc_id + 1) AS p USING (doc_id)""").replace(
    "\nSELECT d.doc_id",
    f""", {VEC_SQL}, of_ AS (SELECT doc_id, count(*) AS k, [{', '.join(f'sum(v[{i}]::DOUBLE)' for i in range(1, 65))}] AS a FROM toks JOIN vec ON vec.word = toks.lemma GROUP BY doc_id)
SELECT d.doc_id""",
)


@query(SOURCE_SQL)
def source_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against the next one as its source, by sums (lsa and word2vec) and by topics."""
    docs, vectors = texts(spark, sf_dir), corpus_vectors(spark, sf_dir)
    found = CO.source_similarity(docs, next_texts(docs), {"lsa": vectors, "lda": vectors}, dims=64)
    return rounded(found, 4)


def without_adjectives(sql: str) -> str:
    """The SQL for an empty adjective list."""
    return sql.replace("(" + ", ".join(f"'{a}'" for a in ADJECTIVES) + ")", "(' ')")


def unrounded(sql: str) -> str:
    """The SQL with its results to 14 places, for further calculation."""
    return sql.replace(", 6) AS", ", 14) AS").replace(", 4) AS", ", 14) AS")


FAMILY_NAMES = {"diversity": [*DIVERSE, *MOVING], "connectives": list(M.I.connectives(M.I.flat_of_paragraphs(M.I.pa.array([], M.I.pa.list_(M.I.pa.string()))))), "givenness": ["pronoun_density", "pronoun_noun_ratio", "repeated_content_lemmas", "repeated_content_and_pronoun_lemmas"]}


def _all_sql() -> str:
    """The other queries' SQL side by side; documents of fewer than two words have a status only."""
    parts = {"a": "q_diversity", "b": "q_mattr_and_ngrams", "c": "q_overlap_sentences", "d": "q_overlap_paragraphs", "e": "q_connectives", "f": "q_givenness"}
    joined = " ".join(f"JOIN ({ORACLES[q]}) AS {k} USING (doc_id)" for k, q in parts.items())
    over = [f"adjacent_overlap_{x}" for level in ("sent", "para") for c in M.CLASSES for x in (f"{c}_{level}", f"{c}_{level}_div_seg", f"binary_{c}_{level}", f"2_{c}_{level}", f"2_{c}_{level}_div_seg", f"binary_2_{c}_{level}")]
    names = [*FAMILY_NAMES["diversity"], *over, *FAMILY_NAMES["connectives"], *FAMILY_NAMES["givenness"]]
    fixed = ", ".join(f'CASE WHEN nwords > 1 THEN "{n}" END AS "{n}"' for n in names)
    return f"SELECT doc_id, CASE WHEN nwords > 1 THEN 'ok' ELSE 'text too short' END AS status, {fixed} FROM ({ORACLES['q_basic_counts']}) AS w {joined}"


@query(_all_sql())
def all_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All indices that need no lexicon, in one pass over the documents."""
    return rounded(M.all_families(texts(spark, sf_dir), adjectives=ADJECTIVES))
