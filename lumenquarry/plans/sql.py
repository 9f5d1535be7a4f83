"""The same queries in SQL, for a second engine to check against."""

from __future__ import annotations

from ..functions.arrays import PRIVATE_TAGS
from ..functions.text import ARTICLES, CITATION_STOP, CLOSED_PREFIXES, CONCISE, KEYWORD_STOP
from ..operators.calibration import HIGH_GRID, LOW_GRID, THRESHOLDS
from ..operators.corpus import SUMMARY, TEMPLATES
from ..operators.decide import ABSTAIN
from .queries import BASELINE, CONFIGS, KNOTS, PLATT, STEPS

SPACE = r"[\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _in(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def words(x: str) -> str:
    return f"list_filter(string_split_regex(coalesce({x}, ''), '{SPACE}+'), lambda w: w <> '')"


def strip(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '^{SPACE}+|{SPACE}+$', '', 'g')"


def eval_tokens(x: str) -> str:
    return (
        rf"list_filter(list_transform(string_split(regexp_replace(lower(coalesce({x}, '')), '[^\p{{L}}\p{{N}}_-]', ' ', 'g'), ' '), "
        f"lambda t: trim(t, '-')), lambda t: t <> '' AND t NOT IN ({_in(ARTICLES)}))"
    )


def eval_form(x: str) -> str:
    return f"array_to_string({eval_tokens(x)}, ' ')"


def bench_form(x: str) -> str:
    return rf"regexp_replace(lower({strip(x)}), '[[:punct:]\s]+$', '')"


def train_form(x: str) -> str:
    return f"lower({strip(x)})"


def by_question(x: str) -> str:
    first = f"regexp_replace(lower(coalesce(({words(x)})[1], '')), '[''?]+$', '')"
    return f"CASE WHEN {first} IN ({_in(CLOSED_PREFIXES)}) THEN 'closed' ELSE 'open' END"


def keywords(x: str) -> str:
    cut = "regexp_replace(regexp_replace(w, '^[?.!,;:]+', ''), '[?.!,;:]+$', '')"
    return f"list_filter(list_transform({words(f'lower({x})')}, lambda w: {cut}), lambda t: len(t) >= 3 AND t NOT IN ({_in(KEYWORD_STOP)}))"


def citation_tokens(x: str) -> str:
    cleaned = rf"regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9\s]', ' ', 'g')"
    return f"list_sort(list_distinct(list_filter({words(cleaned)}, lambda t: len(t) > 1 AND t NOT IN ({_in(CITATION_STOP)}))))"


def slug_keep(x: str) -> str:
    return f"translate(lower(coalesce({x}, '')), ' /#', '___')"


def slug_ascii(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


def ratio(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0.0)"


PS = f"""
ps0 AS (SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY ingested_at, created_at, sample_id, prediction) AS rn FROM per_sample_results),
ps AS (
  SELECT result_id, run_id, sample_id, question, coalesce(ground_truth, '') AS ground_truth, coalesce(prediction, '') AS prediction,
         CASE WHEN trim(coalesce(answer_type, '')) = '' THEN 'open' ELSE lower(trim(answer_type)) END AS answer_type,
         CASE WHEN isnan(confidence) THEN NULL ELSE confidence END AS confidence,
         CASE WHEN isnan(latency_seconds) THEN NULL ELSE latency_seconds END AS latency_seconds,
         coalesce(decision, '') AS decision, citations, visual_answer, retry_count,
         {eval_form('prediction')} AS p, {eval_form('ground_truth')} AS g,
         {eval_form('prediction')} = {eval_form('ground_truth')} AS hit
  FROM ps0 WHERE rn = 1)"""

PAIRS = f"""{PS},
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, sample_id ORDER BY result_id DESC) AS k FROM ps) WHERE k = 1),
base AS (SELECT sample_id, hit AS b_hit FROM last WHERE run_id = '{BASELINE}'),
pairs AS (SELECT last.*, b_hit FROM last JOIN base USING (sample_id) WHERE run_id <> '{BASELINE}')"""

VS = """
vs0 AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY ingested_at, created_at, question, answer) AS rn FROM vqa_samples WHERE sample_id IS NOT NULL),
vs AS (SELECT * FROM vs0 WHERE rn = 1)"""

KEYED = f"""{VS},
keyed AS (SELECT *, {train_form('question')} AS q, {train_form('answer')} AS a, regexp_extract(sample_id, '_(train|val|test)_[^_]+$', 1) AS split FROM vs)"""

_LOADED = r"CASE source WHEN 'vqa_rad' THEN 1 WHEN 'slake' THEN 2 WHEN 'pathvqa' THEN 3 END NULLS LAST, CASE split WHEN 'train' THEN 1 WHEN 'val' THEN 2 WHEN 'test' THEN 3 END NULLS LAST, TRY_CAST(regexp_extract(sample_id, '_(\d+)$', 1) AS BIGINT) NULLS LAST, sample_id"

_BINS = "bins AS (SELECT CAST(i AS INT) AS bin, i / 10.0::DOUBLE AS lo, (i + 1) / 10.0::DOUBLE AS hi FROM range(10) t(i))"
_INSIDE = "confidence >= lo AND (confidence < hi OR (bin = 9 AND confidence <= hi))"
_GRID = ", ".join(f"({h}::DOUBLE, {w}::DOUBLE)" for h in HIGH_GRID for w in LOW_GRID if w < h)
_AT = ", ".join(f"({t}::DOUBLE)" for t in THRESHOLDS)

_THRESHOLDS = f"""{PS},
t AS (SELECT * FROM (VALUES {_AT}) v(threshold)),
rows AS (
  SELECT run_id, threshold, CAST(count(*) FILTER (WHERE confidence >= threshold) AS BIGINT) AS n_covered,
         round({ratio('count(*) FILTER (WHERE confidence >= threshold)', 'count(*)')}, 6) AS coverage,
         round({ratio('count(*) FILTER (WHERE confidence >= threshold AND hit)', 'count(*) FILTER (WHERE confidence >= threshold)')}, 6) AS accuracy
  FROM ps CROSS JOIN t WHERE confidence IS NOT NULL GROUP BY run_id, threshold)"""

_SWEEP = f"""{PS},
grid AS (SELECT * FROM (VALUES {_GRID}) v(high_t, low_t)),
kinds AS (SELECT *, answer_type AS kind FROM ps UNION ALL SELECT *, 'combined' FROM ps),
rows AS (
  SELECT run_id, kind, high_t, low_t, count(*) AS n_samples,
         round({ratio('count(*) FILTER (WHERE confidence < low_t)', 'count(*)')}, 6) AS abstain_rate,
         round({ratio('count(*) FILTER (WHERE confidence >= low_t AND hit)', 'count(*) FILTER (WHERE confidence >= low_t)')}, 6) AS accuracy_when_answered,
         round({ratio('count(*) FILTER (WHERE confidence >= low_t AND hit)', 'count(*)')}, 6) AS overall_accuracy
  FROM kinds CROSS JOIN grid WHERE confidence IS NOT NULL GROUP BY run_id, kind, high_t, low_t)"""

_PRF = f"""{PS},
c AS (
  SELECT run_id,
         count(*) FILTER (WHERE p = 'yes' AND g = 'yes') AS tp, count(*) FILTER (WHERE p = 'no' AND g = 'no') AS tn,
         count(*) FILTER (WHERE p = 'yes' AND g = 'no') AS fp, count(*) FILTER (WHERE p = 'no' AND g = 'yes') AS fn,
         count(*) FILTER (WHERE NOT (p IN ('yes', 'no') AND g IN ('yes', 'no'))) AS excluded
  FROM ps GROUP BY run_id),
prf AS (
  SELECT run_id, excluded, {ratio('tp', 'tp + fp')} AS pr, {ratio('tp', 'tp + fn')} AS re FROM c),
f AS (SELECT *, {ratio('2 * pr * re', 'pr + re')} AS f1 FROM prf)"""

_P, _G = eval_tokens("prediction"), eval_tokens("ground_truth")
_TEXT = f"""{PS},
tok AS (SELECT run_id, answer_type, {_P} AS pt, {_G} AS gt FROM ps),
cnt AS (
  SELECT run_id, answer_type, len(pt) AS np, len(gt) AS ng, len(list_distinct(pt)) AS dp, len(list_distinct(gt)) AS dg,
         len(list_intersect(list_distinct(pt), list_distinct(gt))) AS n_both,
         list_sum(list_transform(list_distinct(pt), lambda t: least(len(list_filter(pt, lambda x: x = t)), len(list_filter(gt, lambda x: x = t))))) AS clipped
  FROM tok),
sc AS (
  SELECT run_id, answer_type, CASE WHEN n_both = 0 THEN 0.0 ELSE 2.0::DOUBLE * n_both / (dp + dg) END AS f,
         CASE WHEN np = 0 OR ng = 0 OR coalesce(clipped, 0) = 0 THEN 0.0
              ELSE (CASE WHEN np > ng THEN 1.0 ELSE exp(1.0 - CAST(ng AS DOUBLE) / np) END) * CAST(clipped AS DOUBLE) / np END AS b
  FROM cnt)"""

_DISC = f"""{PS},
v AS (SELECT run_id, confidence + 0.0 AS c, count(*) AS n, count(*) FILTER (WHERE hit) AS k FROM ps WHERE confidence IS NOT NULL GROUP BY 1, 2),
w AS (SELECT *, n - k AS m, coalesce(sum(n - k) OVER (PARTITION BY run_id ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM v),
d AS (
  SELECT run_id, CAST(sum(k) AS BIGINT) AS n_correct, CAST(sum(m) AS BIGINT) AS n_wrong, {ratio('sum(k * c)', 'sum(k)')} AS mc, {ratio('sum(m * c)', 'sum(m)')} AS mw,
         coalesce(CAST(sum(k * (below + 0.5 * m)) AS DOUBLE) / nullif(CAST(sum(k) AS DOUBLE) * CAST(sum(m) AS DOUBLE), 0), 0.5) AS auroc
  FROM w GROUP BY run_id)"""


def _ece(where: str) -> str:
    return f"""WITH {PS}, {_BINS},
      e AS (SELECT run_id, bin, count(*) AS n, abs(count(*) FILTER (WHERE hit) - sum(confidence)) AS gap
            FROM ps LEFT JOIN bins ON {_INSIDE} WHERE confidence IS NOT NULL AND {where} GROUP BY run_id, bin)
      SELECT run_id, CAST(sum(n) AS BIGINT) AS n, round({ratio('sum(CASE WHEN bin IS NULL THEN 0 ELSE gap END)', 'sum(n)')}, 6) AS ece FROM e GROUP BY run_id"""


_SUMMARY = f"""{_DISC},
acc AS (
  SELECT run_id, round({ratio('count(*) FILTER (WHERE hit)', 'count(*)')}, 6) AS overall_accuracy,
         CASE WHEN count(*) FILTER (WHERE answer_type = 'closed') > 0 THEN round({ratio("count(*) FILTER (WHERE hit AND answer_type = 'closed')", "count(*) FILTER (WHERE answer_type = 'closed')")}, 6) END AS closed_accuracy,
         CASE WHEN count(*) FILTER (WHERE answer_type = 'open') > 0 THEN round({ratio("count(*) FILTER (WHERE hit AND answer_type = 'open')", "count(*) FILTER (WHERE answer_type = 'open')")}, 6) END AS open_accuracy,
         round({ratio("count(*) FILTER (WHERE decision = 'abstain')", 'count(*)')}, 6) AS abstention_rate,
         round({ratio("count(*) FILTER (WHERE decision <> 'abstain' AND hit)", "count(*) FILTER (WHERE decision <> 'abstain')")}, 6) AS accuracy_when_answered,
         round({ratio("count(*) FILTER (WHERE decision = 're_query')", 'count(*)')}, 6) AS re_query_rate,
         round({ratio("count(*) FILTER (WHERE coalesce(retry_count, 0) > 0)", 'count(*)')}, 6) AS retried_rate
  FROM ps GROUP BY run_id),
tx AS (SELECT run_id, round(avg(f), 6) AS token_f1, round(avg(b), 6) AS bleu_1 FROM (
  {_TEXT[_TEXT.index('tok AS'):].replace('tok AS (', 'WITH tok AS (', 1)} SELECT * FROM sc) GROUP BY run_id),
pf AS ({_PRF[_PRF.index('c AS'):].replace('c AS (', 'WITH c AS (', 1)} SELECT run_id, round(f1, 6) AS closed_f1 FROM f),
ec AS ({_ece('true').replace(f'WITH {PS}, ', 'WITH ')}),
summary AS (
  SELECT acc.*, closed_f1, token_f1, bleu_1, ec.ece, round(d.auroc, 6) AS auroc
  FROM acc JOIN pf USING (run_id) JOIN tx USING (run_id) LEFT JOIN ec USING (run_id) LEFT JOIN d USING (run_id))"""

_METRICS = ("overall_accuracy", "closed_accuracy", "open_accuracy", "accuracy_when_answered", "abstention_rate", "closed_f1", "token_f1", "bleu_1", "ece", "auroc")
_ABLATION = ("overall_accuracy", "accuracy_when_answered", "abstention_rate", "ece", "auroc")
_ABLATED = f"""overall_accuracy, CASE WHEN run_id = '{BASELINE}' THEN overall_accuracy ELSE coalesce(nullif(accuracy_when_answered, 0), overall_accuracy) END AS accuracy_when_answered,
  CASE WHEN run_id = '{BASELINE}' THEN CASE WHEN overall_accuracy IS NOT NULL THEN 0.0 END ELSE abstention_rate END AS abstention_rate, ece, auroc"""
_CONFIGS = ", ".join(f"({n}, '{r}')" for n, r in CONFIGS)
_STEPS = ", ".join(f"('{c}', {a}, {b})" for c, a, b in STEPS)

_REL = f"""rel AS (
  SELECT run_id, count(*) AS n_answered,
         count(*) FILTER (WHERE len(list_filter(coalesce(citations, []), lambda c: len(list_intersect({citation_tokens('question')}, {citation_tokens('c.text')})) >= 1)) > 0) AS n_relevant
  FROM ps WHERE decision = 'answer' GROUP BY run_id)"""

_TRIPLES = """
t0 AS (SELECT triple_id AS pos, trim(head) AS head, trim(relation) AS relation, trim(tail) AS tail, trim(category) AS category FROM kg_triples),
t AS (SELECT * FROM t0 WHERE head <> '' AND relation <> '' AND tail <> '' AND category <> ''),
attrs AS (SELECT category, head, relation, arg_max(tail, pos) AS value FROM t WHERE category IN ('disease', 'organ') GROUP BY category, head, relation)"""


def _document(source: str, attribute: str, text: str) -> str:
    return f"concat({source}, '_', {slug_keep('head')}, '_', {slug_keep(attribute)}, '_0') AS doc_key, {text} AS text, {source} AS source, head AS entity_name, {attribute} AS attribute"


def _template() -> str:
    out = ["CASE"]
    for category, by in TEMPLATES.items():
        out += [f"WHEN category = '{category}' AND relation = '{r}' THEN concat('{a}', head, '{b}', value)" for r, (a, b) in by.items()]
    return " ".join([*out, "ELSE concat(head, ' ', relation, ': ', value) END"])


def _summary(category: str) -> str:
    cols = ", ".join(f"max(CASE WHEN relation = '{r}' THEN concat('{p}', value) END) AS {r}" for r, p in SUMMARY[category].items())
    text = f"concat(concat_ws('. ', head, {', '.join(SUMMARY[category])}), '.')"
    doc = _document(f"'kg_{category}'", "'summary'", text)
    return f"SELECT {doc} FROM (SELECT head, {cols} FROM attrs WHERE category = '{category}' GROUP BY head)"


_ATTRIBUTE_DOCS = f"SELECT {_document("concat('kg_', category)", 'relation', _template())} FROM attrs"
_SUMMARY_DOCS = f"{_summary('disease')} UNION ALL {_summary('organ')}"
_RELATION_DOCS = f"SELECT {_document("'kg_organ_rel'", "'belong_to'", "concat(head, ' belongs to the ', tail, '.')")} FROM t WHERE category = 'organ_rel'"

_ONTOLOGY = f"""{_TRIPLES},
o AS (
  SELECT head AS label, max(CASE WHEN relation = 'definition' THEN tail END) AS full_def, max(CASE WHEN relation = 'description' THEN tail END) AS short_def,
         replace(max(CASE WHEN relation = 'alias' THEN tail END), ', ', '|') AS synonyms, CAST(NULL AS VARCHAR) AS obsolete
  FROM t GROUP BY head)"""

_QA = f"""{VS},
qa AS (SELECT *, {strip('question')} AS q, {strip('answer')} AS a FROM vs)"""


def _extra(label: str, c: str) -> str:
    return f"CASE WHEN {strip(c)} <> '' THEN concat(' {label}: ', {strip(c)}) ELSE '' END"


_DENSE = """
q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e, label AS wanted FROM embeddings WHERE vec_id % 50 = 0 {more}),
s AS (SELECT query_id, vec_id AS doc_id, label, wanted, round(list_inner_product(e, embedding::DOUBLE[]), 6) AS score FROM q CROSS JOIN embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)"""


_ASKED = "SELECT item_id AS query_id, question AS text FROM eval_items WHERE item_id % 50 = 0"


def _bm25(k: int, where: str = "true", name: str = "bm", asked: str = _ASKED) -> str:
    toks = lambda x: words(f"lower({x})")
    return f"""
{name}_docs AS (SELECT doc_id, source, text, {toks('text')} AS w FROM documents WHERE {where}),
{name}_n AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(w)) AS avgdl FROM {name}_docs),
{name}_tf AS (SELECT doc_id, len(w) AS dl, term, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM {name}_docs) GROUP BY doc_id, dl, term),
{name}_raw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM {name}_tf, {name}_n GROUP BY term, n),
{name}_idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM {name}_raw) ELSE raw END AS idf FROM {name}_raw),
{name}_q AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({toks('text')}) AS term FROM ({asked})) GROUP BY 1, 2),
{name}_s AS (
  SELECT query_id, doc_id, round(sum(times * idf * CAST(tf AS DOUBLE) * 2.5 / (CAST(tf AS DOUBLE) + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM {name}_q JOIN {name}_idf USING (term) JOIN {name}_tf USING (term), {name}_n GROUP BY query_id, doc_id),
{name} AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC) AS rank FROM {name}_s WHERE score > 0) WHERE rank <= {k})"""


def _diagnostic(name: str) -> str:
    return f"""
{name}_h AS (
  SELECT DISTINCT query_id, source FROM {name} JOIN {name}_docs USING (doc_id) JOIN eval_items ON item_id = query_id
  WHERE len(list_intersect({citation_tokens('question')}, {citation_tokens('text')})) > 0),
{name}_d AS (SELECT source, count(DISTINCT query_id) AS n_hits FROM {name}_h GROUP BY GROUPING SETS ((source), ()))"""


_HYBRID_DENSE = """
dq AS (SELECT vec_id + 5000 AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0 AND vec_id < 400),
ds AS (SELECT query_id, vec_id + 1000 AS doc_id, round(list_inner_product(e, embedding::DOUBLE[]), 6) AS score FROM dq CROSS JOIN embeddings),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ds) WHERE rank <= 20)"""


def _agreement(score: str) -> str:
    """Rows with n_supporting and agreement; ``score`` is the item's score."""
    item = "lower(concat_ws(' ', coalesce(c.text, ''), coalesce(c.entity_name, '')))"
    hit = f"len(list_filter(k, lambda x: contains({item}, x) OR (x LIKE '%s' AND len(x) >= 5 AND contains({item}, left(x, len(x) - 1))))) > 0"
    return f"""
    SELECT *, len(list_filter(evidence, lambda c: {score} >= 0.4 AND {hit})) AS n_supporting,
           coalesce(CAST(len(list_filter(evidence, lambda c: {score} >= 0.4 AND {hit})) AS DOUBLE) / nullif(len(evidence), 0), 0.0) AS agreement"""


_QUERIES = f"""{PS},
in0 AS (
  SELECT result_id, question, answer_type, confidence, coalesce(citations, []) AS evidence,
         CASE WHEN coalesce(visual_answer, '') = '' THEN prediction ELSE visual_answer END AS visual_answer FROM ps),
in1 AS (
  SELECT *, CASE WHEN (answer_type = 'closed' OR lower(trim(visual_answer)) IN ('yes', 'no')) AND len({keywords('question')}) > 0
                 THEN {keywords('question')} ELSE {keywords('visual_answer')} END AS k FROM in0),
ag AS ({_agreement('c.score')} FROM in1)"""


def _decide(retries: int) -> str:
    low = "CASE WHEN answer_type = 'closed' THEN 0.15 ELSE 0.25 END"
    again = "'re_query'" if retries else "'abstain'"
    return f"""*, CASE WHEN coalesce(confidence, 0) < {low} THEN 'abstain' WHEN agreement > 0 THEN 'answer' ELSE {again} END AS decision,
       CASE WHEN coalesce(confidence, 0) < {low} OR agreement <= 0 THEN 0.0
            WHEN confidence >= 0.5 THEN confidence * (0.5 + 0.5 * agreement) ELSE confidence * (0.3 + 0.7 * agreement) END AS grounded"""


_FINAL = f"""{_QUERIES},
first AS (SELECT {_decide(1)} FROM ag),
ag2 AS ({_agreement('c.score + 0.1')} FROM (SELECT * EXCLUDE (n_supporting, agreement, decision, grounded) FROM first WHERE decision = 're_query')),
final AS (
  SELECT *, 0 AS retry_count FROM first WHERE decision <> 're_query' UNION ALL SELECT *, 1 FROM (SELECT {_decide(0)} FROM ag2))"""

_ISO = "CASE WHEN confidence <= {x0} THEN {y0} {mid} ELSE {yn} END".format(
    x0=f"{KNOTS[0][0]}::DOUBLE",
    y0=f"{KNOTS[1][0]}::DOUBLE",
    yn=f"{KNOTS[1][-1]}::DOUBLE",
    mid=" ".join(
        f"WHEN confidence <= {x1}::DOUBLE THEN {y0}::DOUBLE + (confidence - {x0}::DOUBLE) * ({y1}::DOUBLE - {y0}::DOUBLE) / ({x1}::DOUBLE - {x0}::DOUBLE)"
        for x0, x1, y0, y1 in zip(KNOTS[0], KNOTS[0][1:], KNOTS[1], KNOTS[1][1:])
    ),
)

_RETRIEVED = f"""{_QUERIES},
ask AS (SELECT result_id AS query_id, CASE WHEN coalesce(visual_answer, '') = '' THEN question ELSE concat_ws(' ', question, visual_answer) END AS text FROM in0 WHERE result_id % 50 = 0),
{_bm25(20, asked='SELECT * FROM ask')},
fu AS (SELECT query_id, doc_id, rank, round(1.0 / (60 + rank), 9) AS raw FROM bm WHERE rank <= 5),
ev AS (
  SELECT query_id, list(struct_pack(text := d.text, entity_name := d.entity_name, score := sc)) AS e
  FROM (SELECT *, round(raw / max(raw) OVER (PARTITION BY query_id), 6) AS sc FROM fu) JOIN documents d USING (doc_id) GROUP BY query_id),
in2 AS (SELECT in1.* EXCLUDE (evidence), coalesce(e, []) AS evidence FROM in1 LEFT JOIN ev ON query_id = result_id WHERE result_id % 50 = 0),
ag3 AS ({_agreement('c.score')} FROM in2)"""

_C = "(factorial(CAST(b + c AS INT)) / (factorial(CAST({k} AS INT)) * factorial(CAST(b + c - {k} AS INT))))"
_BINOMIAL = f"least(1.0, list_sum(list_filter(list_transform(range(0, b + c + 1), lambda k: {_C.format(k='k')}), lambda x: x <= {_C.format(k='b')})) / pow(2, b + c))"
# erfc by Simpson's rule over 2,000 steps
_TAIL = "greatest(0.0, 1 - 2 / sqrt(pi()) * z / 6000 * list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow(z * i / 2000, 2)))))"


def _progress(every: int, batch: int) -> str:
    return f"""WITH {PS}, w AS (SELECT run_id, result_id, row_number() OVER r AS done, count(*) FILTER (WHERE hit) OVER r AS n_correct, count(*) FILTER (WHERE decision = 'abstain') OVER r AS n_abstained,
          avg(latency_seconds) OVER r AS m, count(*) OVER (PARTITION BY run_id) AS n FROM ps WINDOW r AS (PARTITION BY run_id ORDER BY result_id ROWS UNBOUNDED PRECEDING))
        SELECT run_id, result_id, done, n_correct, n_abstained, round(m, 4) AS mean_latency, round(m * (n - done) / 60, 2) AS minutes_to_go, round(n_correct / CAST(done AS DOUBLE), 6) AS accuracy
        FROM w WHERE done % {every} < {batch} OR done = n"""


SQL: dict[str, str] = {
    "mcnemar_test": f"""WITH {PAIRS}, n AS (SELECT run_id, count(*) FILTER (WHERE hit AND NOT b_hit) AS b, count(*) FILTER (WHERE NOT hit AND b_hit) AS c FROM pairs GROUP BY run_id),
        s AS (SELECT *, CASE WHEN b + c >= 25 THEN pow(abs(b - c) - 1, 2) / (b + c) ELSE 0.0 END AS st FROM n), y AS (SELECT *, sqrt(st / 2) AS z FROM s),
        w AS (SELECT *, CASE WHEN b + c < 5 THEN 1.0 WHEN b + c < 25 THEN {_BINOMIAL} ELSE {_TAIL} END AS p FROM y)
        SELECT run_id, b, c, round(st, 6) AS statistic, round(p, 6) AS p_value, p < 0.05 AS significant FROM w""",
    "retrieval_relevance": f"""WITH {_bm25(5)}, o AS (SELECT query_id, rank, doc_id, score, source, left(bm_docs.text, 100) AS preview,
          CAST(len(list_intersect({citation_tokens('question')}, {citation_tokens('text')})) AS INT) AS token_overlap FROM bm JOIN bm_docs USING (doc_id) JOIN eval_items ON item_id = query_id)
        SELECT *, token_overlap >= 1 AS relevant FROM o""",
    "retrieval_verdict": f"""WITH {_bm25(5)}, h AS (SELECT DISTINCT query_id FROM bm JOIN bm_docs USING (doc_id) JOIN eval_items ON item_id = query_id
          WHERE len(list_intersect({citation_tokens('question')}, {citation_tokens('text')})) > 0),
        c AS (SELECT (SELECT count(DISTINCT item_id) FROM eval_items WHERE item_id % 50 = 0) AS n_questions, (SELECT count(*) FROM h) AS n_hits)
        SELECT *, round({ratio('n_hits', 'n_questions')}, 6) AS hit_rate,
          CASE WHEN {ratio('n_hits', 'n_questions')} >= 0.40 THEN 'PASS' WHEN {ratio('n_hits', 'n_questions')} >= 0.25 THEN 'PARTIAL' ELSE 'FAIL' END AS verdict FROM c""",
    "postings_round_trip": f"WITH {_bm25(20)} SELECT query_id, doc_id, score, CAST(rank AS INT) AS rank FROM bm",
    "index_round_trip": """SELECT source, count(*) AS n_documents, (SELECT count(*) FROM documents) AS doc_count, '1.0.0' AS version FROM documents GROUP BY ROLLUP (source)""",
    "results_round_trip": f"WITH {PS} SELECT run_id, count(*) AS n, count(*) FILTER (WHERE hit) AS n_correct, round({ratio('count(*) FILTER (WHERE hit)', 'count(*)')}, 6) AS accuracy FROM ps GROUP BY run_id",
    "resumed_stream": "SELECT run_id, count(*) AS n, count(*) FILTER (WHERE correct) AS n_correct FROM per_sample_results GROUP BY run_id",
    "scanned_types": f"""SELECT CASE WHEN {train_form('answer')} IN ('yes', 'no') THEN 'closed' ELSE 'open' END AS answer_type, count(*) AS n, count(*) AS n_ids FROM vqa_samples GROUP BY 1""",
    "agreement_texts": f"""WITH {_QUERIES} SELECT result_id, trim(CASE WHEN answer_type = 'closed' OR lower(trim(visual_answer)) IN ('yes', 'no') THEN question ELSE visual_answer END) AS text FROM in0""",
    "embedding_agreement": f"""WITH {_DENSE.format(more='')} SELECT query_id, count(*) FILTER (WHERE score >= 0.6) AS n_supporting, round({ratio('count(*) FILTER (WHERE score >= 0.6)', 'count(*)')}, 6) AS agreement
        FROM r WHERE rank <= 5 GROUP BY query_id""",
    "retrieved_decisions": f"""WITH {_RETRIEVED} SELECT result_id, CAST(len(evidence) AS INT) AS n_evidence, CAST(n_supporting AS INT) AS n_supporting, decision, round(grounded, 6) AS grounded_confidence FROM (SELECT {_decide(1)} FROM ag3)""",
    "normalize_variants": f"""WITH {VS} SELECT sample_id, {eval_form('answer')} AS eval_form, {bench_form('answer')} AS bench_form, {train_form('answer')} AS train_form,
        CASE WHEN {train_form('answer')} IN ('yes', 'no') THEN 'closed' ELSE 'open' END AS type_by_answer, {by_question('question')} AS type_by_question FROM vs""",
    "document_slugs": f"""SELECT doc_id, {slug_keep('entity_name')} AS slug_keep, {slug_ascii('entity_name')} AS slug_ascii,
        CASE WHEN length(text) > 120 THEN concat(left(text, 120), '...') ELSE text END AS preview FROM documents""",
    "question_tokens": f"""WITH {VS} SELECT sample_id, CAST(len({words('lower(question)')}) AS INT) AS n_tokens, array_to_string({keywords('question')}, ' ') AS keywords,
        array_to_string({citation_tokens('question')}, ' ') AS citation_tokens FROM vs""",
    "retrieval_queries": f"""WITH {PS} SELECT result_id, CASE WHEN coalesce(retry_count, 0) > 0 OR coalesce(visual_answer, '') = '' THEN question
        ELSE concat_ws(' ', question, visual_answer) END AS query FROM ps""",
    "training_conversations": f"""WITH {VS}, c AS (SELECT sample_id, question, array_to_string(({words(train_form('answer'))})[1:50], ' ') AS a FROM vs WHERE contains(sample_id, '_train_'))
        SELECT sample_id, concat('<image>', chr(10), question, chr(10), '{CONCISE}') AS asked, a AS answered FROM c WHERE a <> '' AND question IS NOT NULL""",
    "windowed_pixels": """WITH p AS (SELECT vec_id, label, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE) * 1000)) AS p FROM embeddings),
        w AS (SELECT vec_id, list_transform(p, lambda x: CAST(floor((least(greatest(x, label * 10.0 - 100.0), label * 10.0 + 100.0) - (label * 10.0 - 100.0)) / 200.0 * 255) AS INT)) AS o FROM p)
        SELECT vec_id, CAST(list_sum(o) AS INT) AS pixel_sum, list_max(o) AS pixel_max FROM w""",
    "label_masks": f"""WITH w AS (SELECT doc_id, list_transform({words('lower(text)')}, lambda x: length(x)) AS ids FROM documents), i AS (SELECT * FROM w WHERE len(ids) >= 4),
        s AS (SELECT *, 2 + list_max(list_filter(range(0, len(ids) - 1), lambda i: ids[i + 1] = ids[3] AND ids[i + 2] = ids[4])) AS start FROM i)
        SELECT doc_id, CAST(start AS INT) AS start, CAST(len(list_filter(range(1, len(ids) + 1), lambda i: i <= start OR ids[i] = 1)) AS INT) AS n_masked FROM s""",
    "fitted_sizes": """WITH o AS (SELECT o_orderkey, greatest(CAST(floor(o_totalprice / 10) AS INT), 1) AS w, greatest(CAST(o_custkey * 3 AS INT), 1) AS h FROM orders)
        SELECT o_orderkey, CASE WHEN greatest(w, h) <= 4096 THEN w ELSE CAST(floor(w * (4096.0::DOUBLE / greatest(w, h))) AS INT) END AS width,
               CASE WHEN greatest(w, h) <= 4096 THEN h ELSE CAST(floor(h * (4096.0::DOUBLE / greatest(w, h))) AS INT) END AS height FROM o""",
    "public_tags": f"""SELECT c_custkey, array_to_string(list_filter(['PatientName', 'Modality', 'PatientID'], lambda k: k NOT IN ({_in(PRIVATE_TAGS)})), ',') AS kept FROM customer""",
    "chunk_documents": f"""WITH w AS (SELECT doc_id, text, {words('text')} AS w FROM documents),
        c AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 512 THEN [text]
              ELSE list_transform(range(0, greatest(len(w) - 51, 0) + 1, 462), lambda i: array_to_string(w[i + 1:i + 512], ' ')) END AS c FROM w)
        SELECT doc_id, CAST(i - 1 AS INT) AS chunk_index, CAST(length(c[i]) AS INT) AS n_chars, md5(c[i]) AS chunk_md5 FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM c)""",
    "accuracy_by_type": f"""WITH {PS} SELECT run_id, CASE WHEN grouping(answer_type) = 1 THEN 'overall' ELSE answer_type END AS kind, count(*) AS n,
        count(*) FILTER (WHERE hit) AS n_correct, round({ratio('count(*) FILTER (WHERE hit)', 'count(*)')}, 6) AS accuracy
        FROM ps GROUP BY GROUPING SETS ((run_id), (run_id, answer_type))""",
    "closed_confusion": f"WITH {_PRF} SELECT run_id, tp, tn, fp, fn, excluded FROM c",
    "closed_prf": f"WITH {_PRF} SELECT run_id, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1, excluded FROM f",
    "text_scores": f"WITH {_TEXT} SELECT run_id, answer_type, count(*) AS n, round(avg(f), 6) AS token_f1, round(avg(b), 6) AS bleu_1, -1.0::DOUBLE AS bert_score_f1 FROM sc GROUP BY run_id, answer_type",
    "abstention": f"""WITH {PS} SELECT run_id, count(*) AS n, round({ratio("count(*) FILTER (WHERE decision = 'abstain')", 'count(*)')}, 6) AS abstention_rate,
        round({ratio("count(*) FILTER (WHERE decision <> 'abstain' AND hit)", "count(*) FILTER (WHERE decision <> 'abstain')")}, 6) AS accuracy_when_answered,
        round({ratio("count(*) FILTER (WHERE decision = 're_query')", 'count(*)')}, 6) AS re_query_rate,
        round({ratio('count(*) FILTER (WHERE coalesce(retry_count, 0) > 0)', 'count(*)')}, 6) AS retried_rate FROM ps GROUP BY run_id""",
    "correct_abstention": f"""WITH {PAIRS} SELECT run_id, count(*) FILTER (WHERE decision = 'abstain') AS n_abstained, count(*) FILTER (WHERE decision = 'abstain' AND NOT b_hit) AS n_correct,
        round({ratio("count(*) FILTER (WHERE decision = 'abstain' AND NOT b_hit)", "count(*) FILTER (WHERE decision = 'abstain')")}, 6) AS correct_abstention_rate FROM pairs GROUP BY run_id""",
    "grounding_breakdown": f"""WITH {PAIRS}, n AS (SELECT run_id,
        count(*) FILTER (WHERE decision <> 'abstain' AND hit AND NOT b_hit) AS improved, count(*) FILTER (WHERE decision <> 'abstain' AND NOT hit AND b_hit) AS degraded,
        count(*) FILTER (WHERE decision <> 'abstain' AND hit AND b_hit) AS both_correct, count(*) FILTER (WHERE decision <> 'abstain' AND NOT hit AND NOT b_hit) AS both_wrong,
        count(*) FILTER (WHERE decision = 'abstain' AND b_hit) AS abstained_correct, count(*) FILTER (WHERE decision = 'abstain' AND NOT b_hit) AS abstained_wrong,
        count(*) FILTER (WHERE decision = 'abstain') AS abstained, count(*) AS total FROM pairs GROUP BY run_id)
        SELECT *, improved - degraded AS net_improvement FROM n""",
    "citation_relevance": f"WITH {PS}, {_REL} SELECT *, round({ratio('n_relevant', 'n_answered')}, 6) AS citation_relevance FROM rel",
    "citation_hits": f"""WITH {PS}, h AS (SELECT run_id, len(coalesce(citations, [])) > 0 AS c,
          len(list_filter(coalesce(citations, []), lambda c: len(list_filter({_G}, lambda t: len(t) > 2 AND contains(lower(coalesce(c.text, '')), t))) > 0)) AS r FROM ps)
        SELECT run_id, round({ratio('count(*) FILTER (WHERE c AND r > 0)', 'count(*) FILTER (WHERE c)')}, 6) AS citation_hit_rate,
          round({ratio('sum(r)', 'count(*) FILTER (WHERE c)')}, 6) AS mean_relevant_citations, count(*) FILTER (WHERE c) AS total_cited, count(*) FILTER (WHERE NOT c) AS total_uncited
        FROM h GROUP BY run_id""",
    "benchmark_metrics": f"""WITH {PS}, h AS (SELECT *, {bench_form('prediction')} = {bench_form('ground_truth')} AS bh FROM ps),
        c AS (SELECT run_id, count(*) AS n_total, count(*) FILTER (WHERE answer_type = 'closed') AS n_closed, count(*) FILTER (WHERE answer_type = 'open') AS n_open,
          count(*) FILTER (WHERE bh) AS correct_total, count(*) FILTER (WHERE bh AND answer_type = 'closed') AS correct_closed, count(*) FILTER (WHERE bh AND answer_type = 'open') AS correct_open
          FROM h GROUP BY run_id)
        SELECT *, round({ratio('correct_total', 'n_total')}, 6) AS accuracy_total, round({ratio('correct_closed', 'n_closed')}, 6) AS accuracy_closed,
          round({ratio('correct_open', 'n_open')}, 6) AS accuracy_open FROM c""",
    "latency_medians": f"""WITH {PS}, l AS (SELECT run_id, latency_seconds AS x, row_number() OVER (PARTITION BY run_id ORDER BY latency_seconds) - 1 AS i, count(*) OVER (PARTITION BY run_id) AS n
          FROM ps WHERE latency_seconds IS NOT NULL)
        SELECT run_id, count(*) AS n, round(sum(x), 3) AS total_seconds, round(sum(x) / count(*), 3) AS mean_seconds, round(median(x), 4) AS median_seconds,
          round(max(CASE WHEN i = n // 2 THEN x END), 3) AS upper_median_seconds, round(count(*) / sum(x), 2) AS per_second FROM l GROUP BY run_id""",
    "calibration_bins": f"""WITH {PS}, {_BINS}, runs AS (SELECT DISTINCT run_id FROM ps WHERE confidence IS NOT NULL),
        n AS (SELECT run_id, bin, count(*) AS n, count(*) FILTER (WHERE hit) AS k, sum(confidence) AS s FROM ps JOIN bins ON {_INSIDE} GROUP BY run_id, bin)
        SELECT run_id, bin, lo, hi, coalesce(n, 0) AS n, round({ratio('k', 'n')}, 6) AS accuracy, round({ratio('s', 'n')}, 6) AS mean_confidence
        FROM runs CROSS JOIN bins LEFT JOIN n USING (run_id, bin)""",
    "ece": _ece("true"),
    "ece_answered": _ece("decision <> 'abstain'"),
    "discrimination": f"""WITH {_DISC} SELECT run_id, n_correct, n_wrong, round(mc, 6) AS mean_correct, round(mw, 6) AS mean_wrong, round(mc - mw, 6) AS gap, round(auroc, 6) AS auroc FROM d""",
    "threshold_analysis": f"WITH {_THRESHOLDS} SELECT * FROM rows",
    "threshold_recommendation": f"""WITH {_THRESHOLDS} SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY accuracy DESC, threshold) AS rn
        FROM rows WHERE coverage >= 0.5 AND n_covered > 0) WHERE rn = 1""",
    "threshold_sweep": f"WITH {_SWEEP} SELECT * FROM rows",
    "sweep_best_row": f"""WITH {_SWEEP} SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY run_id, kind
        ORDER BY (abstain_rate BETWEEN 0.10 AND 0.25) DESC, accuracy_when_answered DESC, abstain_rate, high_t, low_t) AS rn FROM rows) WHERE rn = 1""",
    "platt_apply": f"""WITH {PS} SELECT result_id, round(greatest(0.01, least(0.99, 1.0 / (1.0 + exp(-({PLATT[0]}::DOUBLE * confidence + {PLATT[1]}::DOUBLE))))), 6) AS calibrated
        FROM ps WHERE confidence IS NOT NULL""",
    "isotonic_apply": f"WITH {PS} SELECT result_id, round(greatest(0.01, least(0.99, {_ISO})), 6) AS calibrated FROM ps WHERE confidence IS NOT NULL",
    "mcnemar_counts": f"""WITH {PAIRS}, n AS (SELECT run_id, count(*) FILTER (WHERE hit AND NOT b_hit) AS b, count(*) FILTER (WHERE NOT hit AND b_hit) AS c FROM pairs GROUP BY run_id)
        SELECT *, round(CASE WHEN b + c >= 25 THEN pow(abs(b - c) - 1, 2) / (b + c) ELSE 0.0 END, 6) AS statistic FROM n""",
    "run_summary": f"WITH {_SUMMARY} SELECT * FROM summary",
    "metric_deltas": f"""WITH {_SUMMARY}, long AS ({' UNION ALL '.join(f"SELECT run_id, '{m}' AS metric, {m} AS value FROM summary" for m in _METRICS)})
        SELECT a.run_id, a.metric, a.value AS agent, b.value AS baseline, round(a.value - b.value, 6) AS delta
        FROM long a JOIN long b ON a.metric = b.metric AND b.run_id = '{BASELINE}' WHERE a.run_id <> '{BASELINE}'""",
    "error_lists": f"""WITH {PAIRS}, e AS (SELECT l.*, coalesce(base.b_hit, hit) AS bh FROM last l LEFT JOIN base USING (sample_id) WHERE run_id = 'agent_a'),
        k AS (SELECT 'wrong' AS kind, 10 AS most, * FROM e WHERE NOT hit AND decision <> 'abstain' UNION ALL SELECT 'over_abstain', 5, * FROM e WHERE decision = 'abstain' AND bh
              UNION ALL SELECT 'improved', 5, * FROM e WHERE hit AND NOT bh UNION ALL SELECT 'improved_answered', 5, * FROM e WHERE hit AND NOT bh AND decision = 'answer')
        SELECT kind, result_id, sample_id, prediction, ground_truth FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY result_id) AS i FROM k) WHERE i <= most""",
    "ablation_table": f"""WITH {_SUMMARY}, cfg AS (SELECT * FROM (VALUES {_CONFIGS}) v(num, run_id)) SELECT num, run_id, {_ABLATED} FROM cfg LEFT JOIN summary USING (run_id)""",
    "component_deltas": f"""WITH {_SUMMARY}, cfg AS (SELECT * FROM (VALUES {_CONFIGS}) v(num, run_id)), tab AS (SELECT num, {_ABLATED} FROM cfg LEFT JOIN summary USING (run_id)),
        st AS (SELECT * FROM (VALUES {_STEPS}) v(component, to_num, from_num))
        SELECT component, to_num, from_num, {', '.join(f'round(a.{m} - b.{m}, 6) AS {m}_delta' for m in _ABLATION)}
        FROM st LEFT JOIN tab a ON a.num = to_num LEFT JOIN tab b ON b.num = from_num""",
    "question_type_table": f"""WITH {_PRF}, cfg AS (SELECT * FROM (VALUES {_CONFIGS}) v(num, run_id)),
        k AS (SELECT run_id, round({ratio("count(*) FILTER (WHERE hit AND answer_type = 'closed')", "count(*) FILTER (WHERE answer_type = 'closed')")}, 6) AS closed_accuracy,
          round({ratio("count(*) FILTER (WHERE hit AND answer_type = 'open')", "count(*) FILTER (WHERE answer_type = 'open')")}, 6) AS open_accuracy,
          count(*) FILTER (WHERE answer_type = 'closed') AS closed_count, count(*) FILTER (WHERE answer_type = 'open') AS open_count FROM ps GROUP BY run_id)
        SELECT num, run_id, closed_accuracy, open_accuracy, round(f1, 6) AS closed_f1, coalesce(closed_count, 0) AS closed_count, coalesce(open_count, 0) AS open_count FROM cfg LEFT JOIN k USING (run_id) LEFT JOIN f USING (run_id)""",
    "demo_entries": f"""WITH {PS}, {VS}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, sample_id ORDER BY result_id DESC) AS k FROM ps) WHERE k = 1)
        SELECT vs.sample_id, CASE WHEN a.result_id IS NOT NULL THEN a.prediction ELSE b.prediction END AS prediction,
          CASE WHEN a.result_id IS NOT NULL THEN 'result' WHEN b.result_id IS NOT NULL THEN 'fallback' ELSE 'none' END AS found
        FROM vs LEFT JOIN l a ON a.sample_id = vs.sample_id AND a.run_id = 'agent_a' LEFT JOIN l b ON b.sample_id = vs.sample_id AND b.run_id = '{BASELINE}'
        WHERE regexp_matches(vs.sample_id, '_test_')""",
    "index_range": rf"WITH {VS} SELECT sample_id FROM vs WHERE TRY_CAST(regexp_extract(sample_id, '_(\d+)$', 1) AS BIGINT) BETWEEN 5 AND 40",
    "report_flags": f"""WITH {_SUMMARY}, {_REL}
        SELECT run_id, abstention_rate > 0.25 AS high_abstention, {ratio('n_relevant', 'n_answered')} < 0.5 AS low_citation_relevance, open_accuracy < 0.30 AS low_open_accuracy, ece > 0.15 AS high_ece,
          overall_accuracy < (SELECT overall_accuracy FROM summary WHERE run_id = '{BASELINE}') AS grounding_hurt FROM summary LEFT JOIN rel USING (run_id)""",
    "running_progress": _progress(25, 1),
    "benchmark_progress": _progress(50, 4),
    "type_counts": f"""WITH {PS} SELECT run_id, count(*) AS total, count(*) FILTER (WHERE answer_type = 'closed') AS closed, count(*) FILTER (WHERE answer_type = 'open') AS open,
        count(*) FILTER (WHERE answer_type NOT IN ('closed', 'open')) AS unknown FROM ps GROUP BY run_id""",
    "resume_remaining": f"""WITH {PS}, {VS} SELECT sample_id FROM vs WHERE regexp_matches(sample_id, '_(val|test)_') AND sample_id NOT IN (SELECT sample_id FROM ps WHERE run_id = 'agent_a' AND sample_id IS NOT NULL)""",
    "kg_attribute_docs": f"WITH {_TRIPLES} {_ATTRIBUTE_DOCS}",
    "kg_summary_docs": f"WITH {_TRIPLES} {_SUMMARY_DOCS}",
    "kg_relation_docs": f"WITH {_TRIPLES} {_RELATION_DOCS}",
    "kg_index_summary": f"WITH {_TRIPLES}, k AS ({_ATTRIBUTE_DOCS} UNION ALL {_SUMMARY_DOCS} UNION ALL {_RELATION_DOCS}) SELECT source, count(*) AS n_documents FROM k GROUP BY ROLLUP (source)",
    "ontology_docs": f"""WITH {_ONTOLOGY}, d AS (SELECT *, CASE WHEN coalesce(synonyms, '') <> '' THEN ' Also known as: ' || replace(synonyms, '|', ', ') ELSE '' END AS known
          FROM o WHERE coalesce(obsolete, '') <> '1' AND coalesce(full_def, short_def) IS NOT NULL)
        SELECT concat('radlex_', {slug_ascii('label')}) AS doc_key, trim(regexp_replace(label || ': ' || coalesce(full_def, short_def) || known, '[^\\x00-\\x7F]', '', 'g')) AS text,
          'radlex' AS source, label AS entity_name, 'definition' AS attribute FROM d""",
    "ontology_skips": f"""WITH {_ONTOLOGY} SELECT CASE WHEN label = '' THEN 'no_label' WHEN obsolete = '1' THEN 'obsolete' WHEN coalesce(full_def, '') = '' AND coalesce(short_def, '') = '' THEN 'no_definition' ELSE 'kept' END AS reason,
        count(*) AS n FROM o GROUP BY 1""",
    "qa_documents": f"""WITH {_QA} SELECT concat('qa_', sample_id) AS doc_key, concat('Question: ', q, ' Answer: ', a,
          CASE WHEN source = 'slake' THEN concat({_extra('Body region', 'body_location')}, {_extra('Modality', 'modality')}, {_extra('Category', 'content_type')}) ELSE '' END) AS text,
          CASE WHEN source = 'slake' THEN 'qa_slake' ELSE 'qa_vqarad' END AS source, sample_id AS entity_name, 'qa_pair' AS attribute
        FROM qa WHERE q <> '' AND a <> '' AND (source = 'vqa_rad' OR (source = 'slake' AND lower(q_lang) = 'en'))""",
    "dataset_profile": f"""WITH {KEYED}, w AS (SELECT *, len({words('answer')}) AS w, row_number() OVER (PARTITION BY source ORDER BY len({words('answer')})) - 1 AS i, count(*) OVER (PARTITION BY source) AS m FROM keyed)
        SELECT source, count(*) AS n, count(*) FILTER (WHERE q = '') AS n_empty_question, count(*) FILTER (WHERE a = '') AS n_empty_answer, round(avg(w), 6) AS mean_words,
          CAST(max(CASE WHEN i = m // 2 THEN w END) AS INT) AS median_words, CAST(max(w) AS INT) AS max_words, round({ratio('count(*) FILTER (WHERE w > 10)', 'count(*)')}, 6) AS share_over_10,
          count(*) FILTER (WHERE w > 50) AS n_over_50, count(*) FILTER (WHERE contains(coalesce(answer, ''), '<') AND contains(coalesce(answer, ''), '>')) AS n_tagged,
          count(DISTINCT a) AS n_answers, count(*) - count(DISTINCT (q, a)) AS n_repeated_pairs FROM w GROUP BY source""",
    "answer_histogram": f"WITH {KEYED} SELECT a AS value, count(*) AS n FROM keyed GROUP BY a ORDER BY n DESC, a LIMIT 5",
    "modality_histogram": f"WITH {VS} SELECT modality AS value, count(*) AS n FROM vs GROUP BY modality",
    "duplicate_keys": f"WITH {KEYED} SELECT q, a, count(*) AS n FROM keyed GROUP BY q, a HAVING count(*) > 1",
    "dedup_first_wins": f"WITH {KEYED} SELECT sample_id FROM (SELECT sample_id, row_number() OVER (PARTITION BY source, q, a ORDER BY {_LOADED}) AS k FROM keyed) WHERE k = 1",
    "dedup_by_image": f"WITH {KEYED} SELECT sample_id FROM (SELECT sample_id, row_number() OVER (PARTITION BY img_name, q, a ORDER BY {_LOADED}) AS k FROM keyed) WHERE k = 1",
    "split_overlap": f"""WITH {KEYED}, tr AS (SELECT * FROM keyed WHERE split = 'train'), he AS (SELECT * FROM keyed WHERE split IN ('val', 'test'))
        SELECT 'question' AS kind, count(*) AS n FROM (SELECT q FROM tr INTERSECT SELECT q FROM he)
        UNION ALL SELECT 'question_answer', count(*) FROM (SELECT q, a FROM tr INTERSECT SELECT q, a FROM he)
        UNION ALL SELECT 'question_answer_image', count(*) FROM (SELECT q, a, img_name FROM tr INTERSECT SELECT q, a, img_name FROM he)""",
    "shared_pairs": f"""WITH {KEYED}, tr AS (SELECT DISTINCT q, a, img_name FROM keyed WHERE split = 'train'), he AS (SELECT DISTINCT q, a, img_name FROM keyed WHERE split IN ('val', 'test'))
        SELECT tr.q, tr.a, bool_or(coalesce(tr.img_name = he.img_name, false)) AS same_image FROM tr JOIN he ON tr.q = he.q AND tr.a = he.a GROUP BY tr.q, tr.a""",
    "missing_references": """SELECT lower(trim(entity_name)) AS value, count(*) AS n FROM documents WHERE entity_name IS NOT NULL
        AND lower(trim(entity_name)) NOT IN (SELECT lower(trim(head)) FROM kg_triples WHERE head IS NOT NULL) GROUP BY 1""",
    "document_index_summary": "SELECT source, count(*) AS n_documents FROM documents GROUP BY ROLLUP (source)",
    "mixed_calibration": rf"""WITH {VS}, tr AS (SELECT sample_id, CAST(regexp_extract(sample_id, '_(\d+)$', 1) AS BIGINT) AS i FROM vs WHERE regexp_matches(sample_id, '^vqa_rad_train_\d+$')),
        r AS (SELECT *, row_number() OVER (ORDER BY i DESC) AS k, count(*) OVER () AS n FROM tr)
        SELECT sample_id FROM vs WHERE regexp_matches(sample_id, '^slake_val_\d+$') UNION ALL SELECT sample_id FROM r WHERE k <= greatest(1, CAST(floor(n * 0.1) AS BIGINT))""",
    "dense_topk": f"WITH {_DENSE.format(more='')} SELECT query_id, doc_id, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5",
    "dense_topk_filtered": f"""WITH {_DENSE.format(more='')}, f AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM r WHERE rank <= 15 AND label = wanted)
        SELECT query_id, doc_id, score, CAST(rank AS INT) AS rank FROM f WHERE rank <= 5""",
    "dense_topk_pushdown": f"""WITH {_DENSE.format(more='')}, f AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE label = wanted)
        SELECT query_id, doc_id, score, CAST(rank AS INT) AS rank FROM f WHERE rank <= 5""",
    "bm25_topk": f"WITH {_bm25(20)} SELECT query_id, doc_id, score, CAST(rank AS INT) AS rank FROM bm",
    "hybrid_rrf_topk": f"""WITH {_bm25(20)}, {_HYBRID_DENSE},
        f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS raw, min(b) AS b, min(d) AS d FROM (
          SELECT query_id, doc_id, rank, rank AS b, NULL AS d FROM bm UNION ALL SELECT query_id, doc_id, rank, NULL, rank FROM dense) GROUP BY query_id, doc_id),
        t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, b ASC NULLS LAST, d ASC NULLS LAST, doc_id) AS rank FROM f),
        n AS (SELECT query_id, doc_id, round(raw / max(raw) OVER (PARTITION BY query_id), 6) AS score, rank FROM t WHERE rank <= 5)
        SELECT query_id, doc_id, score, CAST(rank AS INT) AS rank FROM n WHERE score > 0""",
    "retrieval_diagnostic": f"WITH {_bm25(5)}, {_diagnostic('bm')} SELECT source, n_hits FROM bm_d",
    "index_comparison": f"""WITH {_bm25(5, "source LIKE 'kg_%'", 'sm')}, {_diagnostic('sm')}, {_bm25(5)}, {_diagnostic('bm')}
        SELECT coalesce(a.source, b.source) AS source, coalesce(a.n_hits, 0) AS n_before, coalesce(b.n_hits, 0) AS n_after, coalesce(b.n_hits, 0) - coalesce(a.n_hits, 0) AS delta
        FROM sm_d a FULL JOIN bm_d b ON a.source IS NOT DISTINCT FROM b.source""",
    "vocabulary_size": f"WITH {_bm25(5)} SELECT count(*) AS n_terms, round(min(idf), 6) AS least_idf FROM bm_idf",
    "validation": f"""WITH {VS} SELECT sample_id, CASE WHEN {strip('img_name')} = '' THEN 'Invalid or missing image' WHEN {strip('question')} = '' THEN 'Empty question' ELSE '' END AS validation_error,
        {by_question('question')} AS answer_type FROM vs""",
    "keyword_agreement": f"WITH {_QUERIES} SELECT result_id, CAST(n_supporting AS INT) AS n_supporting, round(agreement, 6) AS agreement FROM ag",
    "supervisor_decisions": f"""WITH {_QUERIES}, x AS (SELECT {_decide(1)} FROM ag)
        SELECT result_id, decision, round(grounded, 6) AS grounded_confidence, CASE WHEN decision = 're_query' THEN 1 ELSE 0 END AS retry_count FROM x""",
    "requery_unrolled": f"WITH {_FINAL} SELECT result_id, decision, retry_count FROM final",
    "formatted_output": f"""WITH {_FINAL}, b AS (SELECT result_id, string_agg(CAST(c.rank_no AS VARCHAR), ',' ORDER BY i) AS ranks FROM (
          SELECT result_id, c, row_number() OVER (PARTITION BY result_id ORDER BY c.score DESC, c.rank_no) AS i FROM (SELECT result_id, unnest(evidence) AS c FROM final WHERE decision = 'answer')) WHERE i <= 3 GROUP BY result_id)
        SELECT result_id, CASE WHEN decision = 'answer' THEN visual_answer ELSE '{ABSTAIN}' END AS final_answer, round(CASE WHEN decision = 'answer' THEN grounded ELSE 0.0 END, 6) AS final_confidence,
          coalesce(ranks, '') AS citation_ranks, decision <> 'answer' AS requires_human_review FROM final LEFT JOIN b USING (result_id)""",
    "event_windows": "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}
