"""DuckDB SQL for every registered query (the correctness oracle).

The SQL restates each operator declaratively over the driver's views
(``documents``, ``embeddings``, ``events``, ``pages``, ``labels``,
``conversations``): window functions, grouped aggregates, a recursive CTE for
connected components. Shared pieces are CTE fragments composed per query.
"""

from __future__ import annotations

from gazette import dims
from gazette.plans import queries as Q


def sq(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(sq(v) for v in values) + "]"


def with_(ctes: list[str], select: str) -> str:
    return "WITH RECURSIVE\n" + ",\n".join(ctes) + "\n" + select


TRIM = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def trim(x: str) -> str:
    return TRIM.format(x=x)


def r6(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6)"


def ts(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S.%f')"


BASIC = [c for c, _ in dims.BASIC_CATEGORIES]

ARTICLES = f"""articles AS (
  SELECT t.doc_id AS article_id, t.doc_id AS pos,
         {trim('t.tr')} AS title,
         {trim('substr(t.text, length(t.tr) + 1)')} AS description,
         t.source, TRY_CAST(regexp_extract(t.source, '([0-9]+)$', 1) AS INTEGER) AS source_ord, p.url, e.ts AS published, t.lang AS language,
         CASE WHEN l.doc_id IS NOT NULL THEN list_filter(
           [CASE WHEN l.quality = 1 THEN 'quality' END, CASE WHEN l.toxic = 1 THEN 'toxic' END],
           lambda x: x IS NOT NULL) END AS labels
  FROM (SELECT *, substr(split_part(text, chr(10), 1), 1, 120) AS tr FROM documents) t
  LEFT JOIN events e ON e.event_id = t.doc_id
  LEFT JOIN pages p ON p.page_id = t.doc_id
  LEFT JOIN labels l ON l.doc_id = t.doc_id)"""

TEXTS = "texts AS (SELECT article_id, title || '. ' || coalesce(description, '') AS text FROM articles)"

AV = """article_vectors AS (
  SELECT a.*, CAST(e.embedding AS DOUBLE[]) AS vec, e.label, 'c' || e.label AS category
  FROM articles a LEFT JOIN embeddings e ON e.vec_id = a.article_id)"""

PROTOS = """protos AS (
  SELECT label AS ord, 'c' || label AS category, list(x ORDER BY i) AS vec FROM (
    SELECT label, i, avg(x) AS x FROM (
      SELECT label, unnest(vec) AS x, unnest(range(len(vec))) AS i FROM article_vectors)
    GROUP BY label, i)
  GROUP BY label)"""

SCORES = """scores AS (
  SELECT a.article_id, p.ord, p.category AS label, coalesce(list_cosine_similarity(a.vec, p.vec), 0.0) AS score
  FROM article_vectors a CROSS JOIN protos p)"""

NEAREST = """best AS (
  SELECT article_id, label AS category, score AS confidence FROM (
    SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY score DESC, ord) AS rn FROM scores)
  WHERE rn = 1),
nearest AS (
  SELECT a.* EXCLUDE (category), CASE WHEN a.vec IS NULL THEN 'unknown' ELSE b.category END AS category, b.confidence
  FROM article_vectors a JOIN best b USING (article_id))"""

BASE_VEC = [ARTICLES, AV, PROTOS, SCORES, NEAREST]


def kw_hits(text: str, words) -> str:
    return f"len(list_filter({sql_list(words)}, lambda k: contains(lower({text}), k)))"


def lexicon_cte(label: str) -> str:
    """CTE ``lexicon``: (grp, entry), words that documents of one label only hold."""
    src = "documents JOIN labels USING (doc_id)" if label == "quality" else "documents"
    space = "'[\\x09-\\x0D\\x1C-\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+'"
    return f"""lexicon AS (
  SELECT min(grp) AS grp, entry FROM (
    SELECT doc_id, CAST({label} AS VARCHAR) AS grp, unnest(list_distinct(regexp_split_to_array(lower(text), {space}))) AS entry
    FROM {src} WHERE {label} IS NOT NULL AND text IS NOT NULL)
  WHERE length(entry) >= {Q.LEXICON_CHARS} GROUP BY entry
  HAVING min(grp) = max(grp) AND count(*) >= {Q.LEXICON_ROWS})"""


def keyword_class(name: str, src: str, text: str, cat_keywords) -> str:
    """CTE ``name``: (article_id, category, confidence) by the keyword rule."""
    values = ", ".join(f"({i}, {sq(c)}, {sql_list(k)})" for i, (c, k) in enumerate(cat_keywords))
    return f"""{name}_kw(ord, category, kws) AS (VALUES {values}),
{name}_sc AS (
  SELECT s.article_id, k.ord, k.category, len(k.kws) AS n,
         len(list_filter(k.kws, lambda x: contains(lower({text}), x))) AS hits
  FROM {src} s CROSS JOIN {name}_kw k),
{name} AS (
  SELECT article_id,
         CASE WHEN hits > 0 THEN category ELSE 'world' END AS category,
         CASE WHEN hits > 0 THEN least(1.0, hits / n) ELSE 0.0 END AS confidence
  FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY hits DESC, ord) AS rn FROM {name}_sc)
  WHERE rn = 1)"""


def relevance_cte(name: str, src: str, text: str) -> str:
    irr, rel = dims.FIXTURE_IRRELEVANT, dims.FIXTURE_RELEVANT
    return f"""{name}_h AS (
  SELECT s.*, {kw_hits(text, irr)} AS irr, {kw_hits(text, rel)} AS rel,
         len(regexp_extract_all({text}, '\\S+')) AS wc
  FROM {src} s),
{name} AS (
  SELECT *,
    CASE WHEN irr > 2 THEN false WHEN rel = 0 AND wc < 10 THEN false WHEN wc < 5 THEN false
         WHEN wc > 500 THEN false ELSE true END AS is_relevant,
    CAST(CASE WHEN irr > 2 THEN 0.1 WHEN rel = 0 AND wc < 10 THEN 0.3 WHEN wc < 5 THEN 0.2
         WHEN wc > 500 THEN 0.2 WHEN rel > 0 THEN least(0.9, 0.5 + rel * 0.1) ELSE 0.7 END AS DOUBLE)
      AS relevance_confidence
  FROM {name}_h)"""


def dbscan_ctes(src: str, eps: float, ms: int) -> list[str]:
    """members: src rows + cluster_id, is_noise, small, cat_first."""
    return [
        f"""pairs AS (
  SELECT x.category, x.pos AS a, y.pos AS b,
         greatest(0.0, least(2.0, 1 - list_cosine_similarity(x.vec, y.vec))) AS dist
  FROM {src} x JOIN {src} y ON x.category = y.category AND x.pos < y.pos
  WHERE 1 - list_cosine_similarity(x.vec, y.vec) <= {eps})""",
        "ends AS (SELECT category, a AS id, b AS o FROM pairs UNION ALL SELECT category, b, a FROM pairs)",
        "deg AS (SELECT id, count(*) AS d FROM ends GROUP BY id)",
        f"""pt AS (SELECT s.category, s.pos AS id, coalesce(d.d, 0) + 1 >= {ms} AS is_core
  FROM {src} s LEFT JOIN deg d ON d.id = s.pos)""",
        """cedge AS (SELECT e.id, e.o FROM ends e
  JOIN pt c1 ON c1.id = e.id AND c1.is_core JOIN pt c2 ON c2.id = e.o AND c2.is_core)""",
        """reach(id, root) AS (
  SELECT id, id FROM pt WHERE is_core
  UNION
  SELECT e.o, r.root FROM reach r JOIN cedge e ON e.id = r.id)""",
        "comp AS (SELECT id, min(root) AS root FROM reach GROUP BY id)",
        """border AS (SELECT e.id, min(c.root) AS root FROM ends e
  JOIN pt b ON b.id = e.id AND NOT b.is_core JOIN comp c ON c.id = e.o GROUP BY e.id)""",
        """lab AS (SELECT p.category, p.id, coalesce(c.root, b.root) AS root
  FROM pt p LEFT JOIN comp c ON c.id = p.id LEFT JOIN border b ON b.id = p.id)""",
        """rk AS (SELECT category, root, dense_rank() OVER (PARTITION BY category ORDER BY root) - 1 AS cid
  FROM (SELECT DISTINCT category, root FROM lab WHERE root IS NOT NULL))""",
        f"sizes AS (SELECT category, count(*) AS n, min(pos) AS cat_first FROM {src} GROUP BY category)",
        f"""members AS (
  SELECT s.*, CAST(CASE WHEN z.n < {ms} THEN 0 ELSE coalesce(r.cid, -1) END AS BIGINT) AS cluster_id,
         (z.n < {ms}) OR coalesce(r.cid, -1) = -1 AS is_noise, z.n < {ms} AS small, z.cat_first
  FROM {src} s JOIN lab l ON l.id = s.pos JOIN sizes z ON z.category = s.category
  LEFT JOIN rk r ON r.category = l.category AND r.root = l.root)""",
    ]


STOP = sql_list(dims.KEYWORD_STOP_WORDS)

CLUSTERS = [
    """mlen AS (SELECT *,
    row_number() OVER (PARTITION BY category, cluster_id
                       ORDER BY length(coalesce(description, '')) + length(coalesce(title, '')) DESC, pos) AS rl,
    row_number() OVER (PARTITION BY category, cluster_id ORDER BY pos) AS rf
  FROM members)""",
    """clu AS (SELECT category, cluster_id, count(*) AS size, bool_or(is_noise) AS is_noise,
    bool_or(small) AS small, min(cat_first) AS cat_first,
    max(CASE WHEN rl = 1 THEN title END) AS l_title, max(CASE WHEN rl = 1 THEN source END) AS l_source,
    max(CASE WHEN rf = 1 THEN title END) AS f_title
  FROM mlen GROUP BY category, cluster_id)""",
    """words AS (SELECT category, cluster_id, pos, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (
    SELECT category, cluster_id, pos,
           string_split_regex(lower(coalesce(title, '') || ' ' || coalesce(description, '')), '\\s+') AS ws
    FROM members))""",
    f"""wc AS (SELECT category, cluster_id, w, count(*) AS n, min(pos * 100000000 + i) AS first FROM words
  WHERE length(w) > 3 AND regexp_full_match(w, '\\p{{L}}+') AND NOT list_contains({STOP}, w)
  GROUP BY category, cluster_id, w)""",
    """kw AS (SELECT category, cluster_id, string_agg(w, ',' ORDER BY r) AS keywords, list(w ORDER BY r) AS kwl
  FROM (SELECT *, row_number() OVER (PARTITION BY category, cluster_id ORDER BY n DESC, first) AS r FROM wc)
  WHERE r <= 5 GROUP BY category, cluster_id)""",
    """clusters AS (SELECT c.category, c.cluster_id, c.size, c.is_noise,
    CASE WHEN c.small THEN c.f_title ELSE c.l_title END AS main_title,
    CASE WHEN c.small THEN NULL ELSE c.l_source END AS main_source,
    coalesce(k.keywords, 'news') AS keywords, coalesce(k.kwl, ['news']) AS kwl, c.cat_first
  FROM clu c LEFT JOIN kw k USING (category, cluster_id))""",
]


def top_cte(n: int) -> str:
    return f"""top AS (SELECT *, row_number() OVER (ORDER BY size DESC, cat_first, cluster_id) AS rank
  FROM clusters WHERE size >= 2 AND NOT is_noise QUALIFY rank <= {n})"""


def fallback_expr(lang: str, n: str = "n_sources", title: str = "main_title", kwl: str = "kwl",
                  size: str = "size") -> str:
    one, many, kw_one, kw_many, empty = dims.FALLBACK_TEMPLATES[lang]
    kw = f"array_to_string({kwl}[1:3], ', ')"

    def fill(t, kw_default, with_n):
        head, rest = t.split("{title}")
        a, b = rest.split("{kw}")
        kwx = f"CASE WHEN len({kwl}) > 0 THEN {kw} ELSE {sq(kw_default)} END"
        if with_n:
            h1, h2 = head.split("{n}")
            headx = f"{sq(h1)} || {n} || {sq(h2)}"
        else:
            headx = sq(head)
        return f"{headx} || coalesce({title}, 'News') || {sq(a)} || {kwx} || {sq(b)}"

    return (f"CASE WHEN coalesce({size}, 0) = 0 THEN {sq(empty)} WHEN {n} <= 1 THEN {fill(one, kw_one, False)} "
            f"ELSE {fill(many, kw_many, True)} END")


def sources_ctes(chosen: str) -> list[str]:
    return [
        f"""srcd AS (SELECT m.category, m.cluster_id, coalesce(m.source, '') AS src
  FROM members m JOIN {chosen} t USING (category, cluster_id) GROUP BY ALL)""",
        """srcs AS (SELECT category, cluster_id, count(*) FILTER (WHERE src <> '') AS n_sources,
    list(src ORDER BY src)[1:3] AS srcl FROM srcd GROUP BY category, cluster_id)""",
    ]


def items_ctes(max_items: int) -> list[str]:
    return [top_cte(max_items)] + sources_ctes("top") + [
        f"""items AS (SELECT t.rank, coalesce(t.main_title, 'No title') AS title,
    {fallback_expr('english', 's.n_sources', 't.main_title', 't.kwl', 't.size')} AS summary,
    t.category, t.size AS source_count, t.keywords, coalesce(s.srcl, []) AS srcl,
    array_to_string(coalesce(s.srcl, []), ',') AS sources
  FROM top t LEFT JOIN srcs s USING (category, cluster_id) WHERE t.rank <= {max_items})"""]


def header_cte() -> str:
    title = dims.DIGEST_TITLE["english"].format(date=Q.AS_OF)
    head, rest = dims.DIGEST_FOOTER["english"].split("{articles}")
    mid, tail = rest.split("{events}")
    return f"""header AS (SELECT {sq(title)} AS title, {sq(Q.AS_OF)} AS date,
    {sq(head)} || total_articles || {sq(mid)} || total_events || {sq(tail)} AS footer,
    'english' AS language, total_articles, total_events
  FROM (SELECT CAST(coalesce(sum(source_count), 0) AS BIGINT) AS total_articles, count(*) AS total_events
        FROM items))"""


ITEM_COLS = "rank, title, summary, category, source_count, keywords, sources"

STORE = [
    keyword_class("kwc", "texts", "s.text", dims.FIXTURE_CATEGORY_KEYWORDS),
    """store AS (SELECT CAST(a.article_id AS VARCHAR) AS id, a.article_id, a.title, a.description AS summary, a.url,
    a.source, a.published AS publish_date, a.language,
    md5(coalesce(a.title, '') || coalesce(a.description, '')) AS title_hash, k.category,
    l.quality = 1 AS is_relevant, k.confidence AS classification_confidence, a.labels AS meta_labels
  FROM articles a JOIN labels l ON l.doc_id = a.article_id JOIN kwc k ON k.article_id = a.article_id)""",
]

NORMALIZE = """norm AS (SELECT id, coalesce(title, '') AS title, coalesce(summary, '') AS description,
    coalesce(url, '') AS url,
    CASE WHEN coalesce(url, '') = '' THEN 'unknown' ELSE coalesce(string_split(url, '/')[3], 'unknown') END AS source,
    publish_date AS published, 'english' AS language
  FROM store)"""

DIGESTS = """digests AS (SELECT strftime(day, '%Y-%m-%d') AS digest_id, created_at,
    CASE WHEN n_other > n_en THEN 'russian' ELSE 'english' END AS language,
    events_count, articles_processed
  FROM (SELECT CAST(published AS DATE) AS day, max(published) AS created_at, count(*) AS articles_processed,
               count(*) FILTER (WHERE language <> 'en') AS n_other, count(*) FILTER (WHERE language = 'en') AS n_en,
               count(DISTINCT source) AS events_count
        FROM articles WHERE published IS NOT NULL GROUP BY 1))"""

MR = f"""mr AS (SELECT event_type AS method, user_id AS article_id, event_id AS pos,
    ({sql_list(BASIC)})[event_id % 9 + 1] AS category,
    CAST(event_id % 100 AS DOUBLE) / 100.0 AS confidence, value AS time
  FROM events)"""

PER_METHOD = """pm AS (SELECT method, count(*) AS count, avg(time) AS avg_time,
    count(DISTINCT category) AS categories_used, min(pos) AS first FROM mr GROUP BY method)"""

COLLECT = [
    ARTICLES,
    """cap AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pos) AS rn FROM articles)
  WHERE rn <= 30)""",
    "lang AS (SELECT * FROM cap WHERE title IS NOT NULL AND title <> '' AND language = 'en')",
    "lenf AS (SELECT * FROM lang WHERE length(title) + length(coalesce(description, '')) <= 800)",
    """dedup AS (SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY title ORDER BY source_ord, source, pos) AS rn2 FROM lenf) WHERE rn2 = 1)""",
    "collected AS (SELECT * FROM dedup ORDER BY source_ord, source, pos LIMIT 100)",
]

TRAINING = """training AS (SELECT a.article_id, a.title || '. ' || coalesce(a.description, '') AS text,
    'q' || l.quality AS label FROM articles a JOIN labels l ON l.doc_id = a.article_id)"""


def tfidf_ctes() -> list[str]:
    from gazette.operators.ml import english_stop_words
    stop = sql_list(english_stop_words())
    tok = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')"
    return [
        TRAINING,
        f"""ttok AS (SELECT article_id, term, count(*) AS tf FROM (
    SELECT article_id, unnest({tok}) AS term FROM training) WHERE NOT list_contains({stop}, term) GROUP BY ALL)""",
        """vocab AS (SELECT term, ln(CAST(1 + (SELECT count(*) FROM training) AS DOUBLE) / (1 + df)) + 1 AS idf
  FROM (SELECT term, sum(tf) AS total, count(*) AS df FROM ttok GROUP BY term ORDER BY total DESC, term LIMIT 3000))""",
        f"""dtok AS (SELECT article_id, term, count(*) AS tf FROM (
    SELECT article_id, unnest({tok}) AS term FROM texts) WHERE NOT list_contains({stop}, term) GROUP BY ALL)""",
        """tfidf AS (SELECT article_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY article_id)) AS weight FROM (
    SELECT d.article_id, d.term, d.tf * v.idf AS w FROM dtok d JOIN vocab v USING (term)))""",
        """trtfidf AS (SELECT article_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY article_id)) AS weight FROM (
    SELECT d.article_id, d.term, d.tf * v.idf AS w FROM ttok d JOIN vocab v USING (term)))""",
    ]


def lang_ctes() -> list[str]:
    tri = "unnest(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3)))"
    return [
        f"""ltri AS (SELECT lang, {tri} AS tri FROM (SELECT lang, lower(text) AS t FROM documents)
  WHERE length(t) >= 3)""",
        "lcnt AS (SELECT lang, tri, count(*) AS c FROM ltri GROUP BY ALL)",
        """ltot AS (SELECT lang, ln(sum(c) + (SELECT count(DISTINCT tri) FROM lcnt)) AS lnorm,
    row_number() OVER (ORDER BY lang) - 1 AS ord FROM lcnt GROUP BY lang)""",
        f"""qtri AS (SELECT article_id, {tri} AS tri FROM (SELECT article_id, lower(title) AS t FROM articles)
  WHERE length(t) >= 3)""",
        "qn AS (SELECT article_id, count(*) AS n FROM qtri GROUP BY article_id)",
        """qs AS (SELECT q.article_id, l.lang, sum(ln(l.c + 1.0)) AS s FROM qtri q JOIN lcnt l USING (tri)
  GROUP BY ALL)""",
        """lsc AS (SELECT a.article_id, t.lang, t.ord, coalesce(n.n, 0) AS nn,
    coalesce(s.s, 0) - t.lnorm * coalesce(n.n, 0) AS score
  FROM articles a CROSS JOIN ltot t LEFT JOIN qn n ON n.article_id = a.article_id
  LEFT JOIN qs s ON s.article_id = a.article_id AND s.lang = t.lang)""",
    ]


def gated_ctes() -> list[str]:
    """Store read -> normalise -> vectors -> gate + nearest -> relevant members -> items."""
    return [ARTICLES, TEXTS, AV, PROTOS] + STORE + [
        NORMALIZE,
        """garts AS (SELECT CAST(n.id AS BIGINT) AS article_id, CAST(n.id AS BIGINT) AS pos, n.title, n.description,
    n.source, n.title || '. ' || coalesce(n.description, '') AS text, CAST(e.embedding AS DOUBLE[]) AS vec
  FROM norm n LEFT JOIN embeddings e ON e.vec_id = CAST(n.id AS BIGINT))""",
        relevance_cte("grel", "garts", "s.text"),
        """gsc AS (SELECT a.article_id, p.ord, p.category AS label, coalesce(list_cosine_similarity(a.vec, p.vec), 0.0) AS score
  FROM garts a CROSS JOIN protos p)""",
        """gbest AS (SELECT article_id, label AS ncat, score AS nconf FROM (
    SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY score DESC, ord) AS rn FROM gsc) WHERE rn = 1)""",
        """gclass AS (SELECT g.*, CASE WHEN NOT g.is_relevant THEN 'irrelevant' WHEN g.vec IS NULL THEN 'unknown'
      ELSE b.ncat END AS category,
    CASE WHEN g.is_relevant THEN b.nconf ELSE 0.0 END AS confidence
  FROM grel g JOIN gbest b USING (article_id))""",
        "grelevant AS (SELECT * FROM gclass WHERE coalesce(is_relevant, true))",
    ] + dbscan_ctes("grelevant", Q.EPS, Q.MIN_SAMPLES) + CLUSTERS + items_ctes(Q.MAX_EVENTS) + [header_cte()]


def collected_digest_ctes() -> list[str]:
    """Collection, then the basic digest over the collected articles."""
    return [ARTICLES, AV, PROTOS, *COLLECT[1:],
            "cav AS (SELECT v.* FROM article_vectors v JOIN collected c USING (article_id))",
            SCORES.replace("article_vectors", "cav"), NEAREST.replace("article_vectors", "cav"),
            *dbscan_ctes("nearest", Q.EPS, Q.MIN_SAMPLES), *CLUSTERS, *items_ctes(Q.MAX_EVENTS), header_cte()]


def basic_digest_ctes() -> list[str]:
    return BASE_VEC + dbscan_ctes("nearest", Q.EPS, Q.MIN_SAMPLES) + CLUSTERS + items_ctes(Q.MAX_EVENTS) + [
        header_cte()]


def _render_text() -> str:
    emoji = " ".join(f"WHEN {sq(c)} THEN {sq(e)}" for c, e in dims.CATEGORY_EMOJI)
    item = (f"(CASE category {emoji} ELSE {sq(dims.DEFAULT_EMOJI)} END) || ' *' || rank || '. ' || "
            "(CASE WHEN length(title) > 60 THEN substr(title, 1, 60) || '...' ELSE title END) || '*' || chr(10) || "
            "summary || (CASE WHEN len(srcl) > 0 THEN chr(10) || '📡 _' || array_to_string(srcl, ', ') || '_' "
            "ELSE '' END) || chr(10) || chr(10)")
    return (f"SELECT '*' || h.title || '*' || chr(10) || chr(10) || coalesce(b.body, '') || '_' || h.footer || '_' "
            f"AS text FROM header h, (SELECT string_agg({item}, '' ORDER BY rank) AS body FROM items) b")


def build() -> dict[str, str]:
    BA = [ARTICLES]
    BT = [ARTICLES, TEXTS]
    sub_case = " ".join(f"WHEN sub IN ({', '.join(sq(s) for s in subs)}) THEN {sq(m)}"
                              for m, subs in dims.CATEGORY_HIERARCHY)
    subs_list = sql_list(Q.SUB_CATEGORIES)
    desc_list = sql_list(Q.DESCRIPTION_LABELS)
    desc_case = " ".join(f"WHEN {sq(d)} THEN {sq(c)}" for c, d in dims.BASIC_CATEGORIES)
    answer_model = Q.ANSWER_MODEL.split("/")[-1]
    rel_all = BT + [relevance_cte("rel", "texts", "s.text")]

    o: dict[str, str] = {}
    # ---------------------------------------------------------------- collection
    o["collect_cap_per_source"] = with_(COLLECT, "SELECT article_id, source, title, description FROM cap")
    o["collect_language"] = with_(COLLECT, "SELECT article_id, source, title FROM lang")
    o["collect_length"] = with_(COLLECT, "SELECT article_id, source, title FROM lenf")
    o["collect_dedup_title"] = with_(COLLECT, "SELECT article_id, source, title FROM dedup")
    o["collect_pipeline"] = with_(COLLECT, "SELECT article_id, source, title, description FROM collected")
    o["collect_report"] = with_(COLLECT, "SELECT count(*) AS articles, count(DISTINCT source) AS sources FROM collected")
    o["compose_text"] = with_(BA, "SELECT article_id, title || '. ' || coalesce(description, '') AS text, "
                                  "'query: ' || title || '. ' || coalesce(description, '') AS text_e5 FROM articles")
    o["lang_detect"] = with_(BA + lang_ctes(), f"""SELECT article_id, CASE WHEN nn > 0 THEN lang END AS detected,
  CASE WHEN nn > 0 THEN {r6('score')} END AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY score DESC, ord) AS rn FROM lsc) WHERE rn = 1""")
    detected = f"""detected AS (SELECT article_id, CASE WHEN nn > 0 THEN lang END AS dlang FROM (
  SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY score DESC, ord) AS rn FROM lsc) WHERE rn = 1)"""
    o["collect_detected"] = with_(BA + lang_ctes() + [detected, """arts2 AS (SELECT a.* EXCLUDE (language),
  d.dlang AS language FROM articles a JOIN detected d USING (article_id))"""] + [
        c.replace("FROM articles)", "FROM arts2)") for c in COLLECT[1:]],
        "SELECT article_id, source, title FROM collected")
    # ---------------------------------------------------------------- relevance
    o["keyword_hits"] = with_(BT, f"""SELECT article_id, {kw_hits('text', dims.FIXTURE_IRRELEVANT)} AS irrelevant_hits,
  {kw_hits('text', dims.FIXTURE_RELEVANT)} AS relevant_hits FROM texts""")
    o["keyword_hits_lexicon"] = with_(BT + [lexicon_cte("quality")], """SELECT article_id,
  (SELECT count(*) FROM lexicon WHERE grp = '0' AND contains(lower(text), entry)) AS irrelevant_hits,
  (SELECT count(*) FROM lexicon WHERE grp = '1' AND contains(lower(text), entry)) AS relevant_hits FROM texts""")
    o["classify_lexicon"] = with_(BT + [lexicon_cte("lang")], f"""SELECT article_id,
  CASE WHEN hits > 0 THEN grp ELSE 'world' END AS category,
  {r6('CASE WHEN hits > 0 THEN least(1.0, hits / n) ELSE 0.0 END')} AS confidence FROM (
  SELECT t.article_id, g.grp, g.n, (SELECT count(*) FROM lexicon l WHERE l.grp = g.grp AND contains(lower(t.text), l.entry)) AS hits
  FROM texts t CROSS JOIN (SELECT grp, count(*) AS n FROM lexicon GROUP BY grp) g)
QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY hits DESC, grp) = 1""")
    o["relevance"] = with_(rel_all, f"SELECT article_id, is_relevant, {r6('relevance_confidence')} AS relevance_confidence, "
                                    "wc AS word_count FROM rel")
    o["relevance_split"] = with_(rel_all, "SELECT article_id, CASE WHEN coalesce(is_relevant, true) THEN 'relevant' "
                                          "ELSE 'irrelevant' END AS side FROM rel")
    o["relevance_report"] = with_(rel_all, """SELECT relevant, total, round(relevant * 100.0 / total, 1) AS percent FROM (
  SELECT count(*) FILTER (WHERE coalesce(is_relevant, true)) AS relevant, count(*) AS total FROM rel)""")
    # ---------------------------------------------------------------- classification
    o["classify_keyword"] = with_(BT + [keyword_class("kwc", "texts", "s.text", dims.FIXTURE_CATEGORY_KEYWORDS)],
                                  f"SELECT article_id, category, {r6('confidence')} AS confidence, "
                                  "'keyword_based' AS method FROM kwc")
    o["prototypes"] = with_([ARTICLES, AV, PROTOS], f"""SELECT CAST(ord AS INTEGER) AS ord, category, CAST(dim AS BIGINT) AS dim,
  {r6('x')} AS x FROM (SELECT ord, category, unnest(vec) AS x, unnest(range(len(vec))) AS dim FROM protos)""")
    o["classify_nearest"] = with_(BASE_VEC, f"SELECT article_id, category, {r6('confidence')} AS confidence FROM nearest")
    o["classify_nearest_table"] = with_([ARTICLES, AV, """sprotos AS (
  SELECT category, row_number() OVER (ORDER BY category) AS ord, list(x ORDER BY i) AS vec FROM (
    SELECT category || '/' || source AS category, i, avg(x) AS x FROM (
      SELECT category, source, unnest(vec) AS x, unnest(range(len(vec))) AS i FROM article_vectors WHERE vec IS NOT NULL)
    GROUP BY 1, i) GROUP BY category)""", """sbest AS (
  SELECT a.article_id, p.category, coalesce(list_cosine_similarity(a.vec, p.vec), 0.0) AS s FROM article_vectors a CROSS JOIN sprotos p
  QUALIFY row_number() OVER (PARTITION BY a.article_id ORDER BY round(s, 9) DESC, p.ord) = 1)"""],
        f"""SELECT a.article_id, CASE WHEN a.vec IS NULL THEN 'unknown' ELSE b.category END AS category,
  {r6('CASE WHEN a.vec IS NULL THEN 0.0 ELSE b.s END')} AS confidence FROM article_vectors a JOIN sbest b USING (article_id)""")
    o["label_top1"] = with_(BASE_VEC, f"SELECT article_id, category, {r6('confidence')} AS confidence FROM best")
    o["label_from_description"] = with_([ARTICLES, AV, PROTOS, SCORES], f"""SELECT article_id,
  CASE ({desc_list})[ord + 1] {desc_case} ELSE 'world' END AS category FROM (
  SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY score DESC, ord) AS rn FROM scores) WHERE rn = 1""")
    o["vote_weighted"] = with_([MR], f"""SELECT article_id, category, {r6('m')} AS confidence,
  'ensemble_' || tot || 'models' AS method FROM (
  SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY round(s, 9) DESC, f) AS rn,
         sum(n) OVER (PARTITION BY article_id) AS tot FROM (
    SELECT article_id, category, sum(confidence) AS s, avg(confidence) AS m, min(pos) AS f, count(*) AS n
    FROM mr GROUP BY article_id, category)) WHERE rn = 1""")
    ans = trim("text")
    o["label_from_answer"] = f"""SELECT conv_id, turn,
  CASE WHEN text IS NULL THEN 'world' ELSE coalesce(
    list_filter({sql_list(Q.ANSWER_LABELS)}, lambda c: contains(lower({ans}), c))[1], 'world') END AS category,
  CASE WHEN text IS NULL THEN 0.0 ELSE 0.8 END AS confidence,
  CASE WHEN text IS NULL THEN {sq('llm_' + answer_model + '_error')} ELSE {sq('llm_' + answer_model)} END AS method
FROM conversations WHERE role = 'assistant'"""
    o["classify_gated"] = with_(BASE_VEC + [
        "avt AS (SELECT article_id, title || '. ' || coalesce(description, '') AS text FROM article_vectors)",
        relevance_cte("grel", "avt", "s.text")], f"""SELECT g.article_id, g.is_relevant,
  {r6('g.relevance_confidence')} AS relevance_confidence,
  CASE WHEN g.is_relevant THEN n.category ELSE 'irrelevant' END AS category,
  {r6('CASE WHEN g.is_relevant THEN n.confidence ELSE 0.0 END')} AS confidence
FROM grel g JOIN nearest n USING (article_id)""")
    o["category_rollup"] = with_([MR], f"""SELECT main_category, sub_category, count(*) AS articles FROM (
  SELECT CASE {sub_case} ELSE 'other' END AS main_category, sub AS sub_category FROM (
    SELECT ({subs_list})[pos % {len(Q.SUB_CATEGORIES)} + 1] AS sub FROM mr))
GROUP BY ROLLUP (main_category, sub_category)""")
    o["training_rows"] = with_([ARTICLES, TRAINING], "SELECT text, label, CAST(c AS BIGINT) AS copy FROM training, "
                                                     "range(1, 4) r(c)")
    # ---------------------------------------------------------------- TF-IDF family
    o["tfidf"] = with_(BT + tfidf_ctes(), f"SELECT article_id, term, {r6('weight')} AS weight FROM tfidf")
    o["classify_nb"] = with_(BT + tfidf_ctes() + [
        "fc AS (SELECT tr.label, t.term, sum(t.weight) AS fc FROM trtfidf t JOIN training tr USING (article_id) GROUP BY ALL)",
        """cls AS (SELECT c.label, ln(c.n_c) - ln((SELECT count(*) FROM training)) AS prior,
    ln(coalesce(t.total, 0) + 1.0 * (SELECT count(*) FROM vocab)) AS lnorm,
    row_number() OVER (ORDER BY c.label) - 1 AS ord
  FROM (SELECT label, count(*) AS n_c FROM training GROUP BY label) c
  LEFT JOIN (SELECT label, sum(fc) AS total FROM fc GROUP BY label) t USING (label))""",
        "mass AS (SELECT article_id, sum(weight) AS x FROM tfidf GROUP BY article_id)",
        """seen AS (SELECT d.article_id, f.label, sum(d.weight * ln(f.fc + 1.0)) AS s
  FROM tfidf d JOIN fc f USING (term) GROUP BY ALL)""",
        """jll AS (SELECT d.article_id, c.label, c.ord, c.prior - c.lnorm * coalesce(m.x, 0) + coalesce(s.s, 0) AS j
  FROM texts d CROSS JOIN cls c LEFT JOIN mass m ON m.article_id = d.article_id
  LEFT JOIN seen s ON s.article_id = d.article_id AND s.label = c.label)""",
        """nbr AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY j DESC, ord) AS rn,
    max(j) OVER (PARTITION BY article_id) AS mx FROM jll)"""],
        f"""SELECT b.article_id, b.label AS category, {r6('1.0 / z.den')} AS confidence FROM nbr b
JOIN (SELECT article_id, sum(exp(j - mx)) AS den FROM nbr GROUP BY article_id) z USING (article_id) WHERE b.rn = 1""")
    o["classify_tfidf_nearest"] = with_(BT + tfidf_ctes() + [
        """tp AS (SELECT tr.label, t.term, sum(t.weight) / any_value(c.n) AS p FROM trtfidf t JOIN training tr USING (article_id)
  JOIN (SELECT label, count(*) AS n FROM training GROUP BY label) c ON c.label = tr.label GROUP BY tr.label, t.term)""",
        "tn AS (SELECT label, sqrt(sum(p * p)) AS norm FROM tp GROUP BY label)",
        """td AS (SELECT d.article_id, p.label, sum(d.weight * p.p) AS dot FROM tfidf d JOIN tp p USING (term) GROUP BY ALL)""",
        """ts AS (SELECT a.article_id, n.label, coalesce(d.dot / n.norm, 0.0) AS score FROM texts a CROSS JOIN tn n
  LEFT JOIN td d ON d.article_id = a.article_id AND d.label = n.label)"""], f"""SELECT article_id, label AS category,
  {r6('score')} AS confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY score DESC, label) AS rn FROM ts) WHERE rn = 1""")
    # ---------------------------------------------------------------- clustering
    members2 = BASE_VEC + dbscan_ctes("nearest", Q.EPS, Q.MIN_SAMPLES)
    members4 = BASE_VEC + dbscan_ctes("nearest", Q.EPS, 4)
    o["neighbor_pairs"] = with_(members2, f"SELECT category, a, b, {r6('dist')} AS dist FROM pairs")
    tree = BASE_VEC + dbscan_ctes("nearest", Q.TREE_EPS, 4)
    o["neighbor_pairs_tree"] = with_(tree, f"SELECT category, a, b, {r6('dist')} AS dist FROM pairs")
    o["dbscan_tree"] = with_(tree, "SELECT category, pos, cluster_id, is_noise FROM members")
    o["dbscan"] = with_(members2, "SELECT category, pos, cluster_id, is_noise FROM members")
    o["dbscan_border"] = with_(members4, "SELECT category, pos, cluster_id, is_noise FROM members")
    o["clusters"] = with_(members2 + CLUSTERS, """SELECT category, cluster_id, size, is_noise, main_title, main_source,
  keywords FROM clusters""")
    o["cluster_keywords"] = with_(members2 + CLUSTERS, "SELECT category, cluster_id, keywords FROM clusters")
    o["significant_clusters"] = with_(members2 + CLUSTERS, """SELECT category,
  count(*) FILTER (WHERE size >= 2 AND NOT is_noise) AS significant FROM clusters GROUP BY category""")
    o["top_clusters"] = with_(members2 + CLUSTERS + [top_cte(10)],
                              "SELECT rank, category, cluster_id, size, main_title FROM top")
    o["clusters_trimmed"] = with_(members2, "SELECT category, cluster_id, pos, title, coalesce(source, '') AS source FROM members")
    # ---------------------------------------------------------------- digest
    text_ctes = [
        """blocks AS (SELECT category, cluster_id, i, blk, len,
    CAST(sum(len) OVER (PARTITION BY category, cluster_id ORDER BY i) AS BIGINT) AS upto FROM (
      SELECT *, length(blk) AS len FROM (
        SELECT category, cluster_id, i,
          'Article ' || i || ' (' || coalesce(source, 'unknown') || '):' || chr(10) || 'Title: ' || coalesce(title, '')
          || chr(10) || 'Description: ' || coalesce(description, '') || chr(10) || chr(10) AS blk
        FROM (SELECT *, row_number() OVER (PARTITION BY category, cluster_id ORDER BY pos) AS i FROM tmembers))))""",
        """fo AS (SELECT category, cluster_id, min(i) FILTER (WHERE upto > 2000) AS first_over FROM blocks
  GROUP BY category, cluster_id)""",
        f"""ctext AS (SELECT category, cluster_id, {trim("string_agg(piece, '' ORDER BY i)")} AS cluster_text FROM (
    SELECT b.category, b.cluster_id, b.i,
      CASE WHEN f.first_over IS NULL OR b.i < f.first_over THEN b.blk
           WHEN b.i = f.first_over AND 2000 - (b.upto - b.len) > 100
             THEN substr(b.blk, 1, 2000 - (b.upto - b.len)) || '...' || chr(10) END AS piece
    FROM blocks b JOIN fo f USING (category, cluster_id)) WHERE piece IS NOT NULL
  GROUP BY category, cluster_id)""",
    ]
    o["cluster_text"] = with_(members2 + ["tmembers AS (SELECT * FROM members WHERE NOT is_noise)"] + text_ctes,
                              "SELECT category, cluster_id, cluster_text FROM ctext")
    sp_en, sp_ru = dims.SYSTEM_PROMPT["english"], dims.SYSTEM_PROMPT["russian"]
    head = dims.USER_PROMPT_HEAD
    o["summary_prompt"] = with_(members2 + CLUSTERS + [top_cte(Q.MAX_EVENTS),
                                "tmembers AS (SELECT m.* FROM members m JOIN top t USING (category, cluster_id))"]
                                + text_ctes, f"""SELECT category, cluster_id, 'english' AS language, {sq(sp_en)} AS system_prompt,
  {sq(head)} || cluster_text || {sq(dims.USER_PROMPT_TAIL['english'])} AS user_prompt FROM ctext
UNION ALL
SELECT category, cluster_id, 'russian', {sq(sp_ru)}, {sq(head)} || cluster_text || {sq(dims.USER_PROMPT_TAIL['russian'])}
FROM ctext""")
    o["fallback_summary"] = with_(members2 + CLUSTERS + sources_ctes("clusters"), f"""SELECT c.category, c.cluster_id,
  {fallback_expr('english', 's.n_sources', 'c.main_title', 'c.kwl', 'c.size')} AS summary_en,
  {fallback_expr('russian', 's.n_sources', 'c.main_title', 'c.kwl', 'c.size')} AS summary_ru
FROM clusters c JOIN srcs s USING (category, cluster_id)""")
    basic = basic_digest_ctes()
    o["digest_items"] = with_(basic, f"SELECT {ITEM_COLS} FROM items")
    o["digest"] = with_(basic, "SELECT * FROM header")
    o["digest_text"] = with_(basic, _render_text())
    gated = gated_ctes()
    meta = """meta AS (SELECT h.*, (SELECT count(*) FROM gclass) AS articles_processed,
    (SELECT count(*) FROM gclass WHERE coalesce(is_relevant, true)) AS relevant_articles,
    (SELECT count(*) FROM gclass WHERE NOT coalesce(is_relevant, true)) AS irrelevant_articles,
    '2.0_enhanced' AS pipeline_version FROM header h)"""
    o["digest_metadata"] = with_(gated + [meta], "SELECT * FROM meta")
    o["digest_basic"] = with_(collected_digest_ctes(), f"""SELECT {ITEM_COLS}, h.title AS digest_title, h.footer, h.total_articles,
  h.total_events FROM items i, header h""".replace("SELECT rank, title", "SELECT i.rank, i.title"))
    o["digest_gated"] = with_(gated + [meta], f"""SELECT i.rank, i.title, i.summary, i.category, i.source_count,
  i.keywords, i.sources, m.title AS digest_title, m.footer, m.total_articles, m.total_events, m.articles_processed,
  m.relevant_articles, m.irrelevant_articles, m.pipeline_version FROM items i, meta m""")
    # ---------------------------------------------------------------- store
    o["article_hash"] = with_(BA, "SELECT article_id, md5(coalesce(title, '') || coalesce(description, '')) AS title_hash "
                                  "FROM articles")
    o["store_insert_new"] = with_(BT + STORE, """SELECT pos, title_hash, coalesce(title, '') AS title,
  coalesce(source, '') AS source, true AS is_relevant FROM (
  SELECT *, row_number() OVER (PARTITION BY title_hash ORDER BY pos) AS rn FROM (
    SELECT *, md5(coalesce(title, '') || coalesce(description, '')) AS title_hash FROM articles))
WHERE rn = 1 AND title_hash NOT IN (SELECT title_hash FROM store)""")
    o["store_saved_ids"] = with_(BT + STORE, """SELECT a.pos, md5(coalesce(a.title, '') || coalesce(a.description, '')) AS title_hash,
  s.existing_id FROM articles a LEFT JOIN (SELECT title_hash, min(id) AS existing_id FROM store GROUP BY title_hash) s
  ON s.title_hash = md5(coalesce(a.title, '') || coalesce(a.description, ''))""")
    o["store_digest_record"] = with_(basic, """SELECT language, CAST(total_events AS BIGINT) AS events_count,
  CAST(0 AS BIGINT) AS articles_processed, '2.0_enhanced' AS pipeline_version, '0.7' AS clustering_eps, footer
FROM header""")
    o["store_mark_processed"] = with_(BASE_VEC, f"""SELECT CAST(article_id AS VARCHAR) AS article_id,
  {ts("TIMESTAMP '" + Q.RUN_TS + "'")} AS processed_at, '1.0' AS pipeline_version,
  'nearest_prototype' AS classification_method FROM nearest""")
    o["store_update_relevance"] = with_(rel_all + STORE, f"""SELECT s.id,
  CASE WHEN r.article_id IS NOT NULL THEN r.is_relevant ELSE s.is_relevant END AS is_relevant,
  {r6('r.relevance_confidence')} AS relevance_confidence,
  CASE WHEN r.article_id IS NOT NULL THEN {ts("TIMESTAMP '" + Q.RUN_TS + "'")} END AS relevance_updated_at
FROM store s LEFT JOIN rel r ON CAST(r.article_id AS VARCHAR) = s.id""")
    o["store_get_articles"] = with_(BT + STORE, f"""SELECT id, title, {ts('publish_date')} AS publish_date FROM store
WHERE list_contains(meta_labels, 'quality') AND regexp_matches(url, 'EXAMPLE', 'i')
  AND publish_date >= TIMESTAMP '2024-01-01 06:00:00'
ORDER BY publish_date DESC NULLS LAST, id LIMIT 100""")
    o["store_normalize"] = with_(BT + STORE + [NORMALIZE], f"""SELECT id, title, description, url, source,
  {ts('published')} AS published, language FROM norm""")
    o["store_get_digests"] = with_([ARTICLES, DIGESTS], f"""SELECT digest_id, {ts('created_at')} AS created_at, language,
  events_count FROM digests WHERE language = 'english' ORDER BY created_at DESC, digest_id LIMIT 10""")
    # ---------------------------------------------------------------- statistics
    o["stats_totals"] = with_(BT + STORE + [DIGESTS], """SELECT count(*) AS total_articles,
  count(*) FILTER (WHERE is_relevant) AS relevant_articles, count(*) FILTER (WHERE NOT is_relevant) AS irrelevant_articles,
  (SELECT count(*) FROM digests) AS total_digests FROM store""")
    o["stats_by_category"] = with_(BT + STORE, "SELECT category, count(*) AS count FROM store GROUP BY category")
    o["stats_by_source"] = with_(BT + STORE, "SELECT source, count(*) AS count FROM store GROUP BY source")
    o["run_stats"] = with_(gated, """SELECT (SELECT count(*) FROM store) AS articles_collected,
  count(*) AS articles_classified, count(*) FILTER (WHERE coalesce(is_relevant, true)) AS relevant_articles,
  count(*) FILTER (WHERE NOT coalesce(is_relevant, true)) AS irrelevant_articles,
  (SELECT count(*) FROM items) AS events_created FROM gclass""")
    o["category_counts"] = with_(gated, """SELECT coalesce(category, 'unknown') AS category, count(*) AS count
FROM grelevant GROUP BY 1 ORDER BY count DESC, category NULLS FIRST LIMIT 5""")
    o["method_comparison"] = with_([MR, PER_METHOD], f"""SELECT pm.method, pm.count, {r6('pm.avg_time')} AS avg_time,
  pm.categories_used, tc.top_category FROM pm JOIN (
  SELECT method, category AS top_category FROM (
    SELECT method, category, row_number() OVER (PARTITION BY method ORDER BY count(*) DESC, min(pos)) AS rn
    FROM mr GROUP BY method, category) WHERE rn = 1) tc USING (method)""")
    o["method_speed_rank"] = with_([MR, PER_METHOD], f"""SELECT row_number() OVER (ORDER BY avg_time, first) AS rank,
  method, {r6('avg_time')} AS avg_time FROM pm WHERE avg_time > 0 QUALIFY rank <= 5""")
    o["method_diversity_rank"] = with_([MR, PER_METHOD], """SELECT row_number() OVER (ORDER BY categories_used DESC, first)
  AS rank, method, categories_used FROM pm QUALIFY rank <= 5""")
    o["method_distribution"] = with_([MR, PER_METHOD], """SELECT d.method, d.rank, d.category, d.n,
  round(d.n * 100.0 / f.count, 1) AS percent FROM (
  SELECT method, category, n, row_number() OVER (PARTITION BY method ORDER BY n DESC, first) AS rank FROM (
    SELECT method, category, count(*) AS n, min(pos) AS first FROM mr GROUP BY method, category)
) d JOIN (SELECT method, count FROM pm ORDER BY first LIMIT 3) f USING (method) WHERE d.rank <= 5""")
    o["method_summary"] = with_([MR, PER_METHOD], f"""SELECT pm.method, pm.count, {r6('pm.avg_time')} AS avg_time,
  c.category, c.n FROM pm JOIN (SELECT method, category, count(*) AS n FROM mr GROUP BY method, category) c
  USING (method)""")
    o["method_results"] = with_(BASE_VEC + [
        "avt AS (SELECT article_id, title || '. ' || coalesce(description, '') AS text FROM article_vectors)",
        keyword_class("kwc", "avt", "s.text", dims.FIXTURE_CATEGORY_KEYWORDS)],
        f"""SELECT article_id, 'keyword' AS result, category, {r6('confidence')} AS confidence, 'keyword_based' AS method
FROM kwc
UNION ALL
SELECT article_id, 'nearest', category, {r6('confidence')}, 'nearest_prototype' FROM nearest""")
    # ---------------------------------------------------------------- sources
    bad = "'[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]'"
    o["feed_scan"] = with_(BA, f"""SELECT article_id, source,
  {trim(f"regexp_replace(title, {bad}, '', 'g')")} AS title,
  {trim(f"regexp_replace(coalesce(description, ''), {bad}, '', 'g')")} AS description,
  regexp_replace(coalesce(url, ''), {bad}, '', 'g') AS url FROM articles""")
    o["feed_collect"] = with_([f"""articles AS (SELECT article_id, pos, source, source_ord, language,
  {trim(f"regexp_replace(title, {bad}, '', 'g')")} AS title,
  {trim(f"regexp_replace(coalesce(description, ''), {bad}, '', 'g')")} AS description FROM ({ARTICLES[len('articles AS ('):-1]}))"""]
        + COLLECT[1:], "SELECT article_id, source, title FROM collected")
    # ---------------------------------------------------------------- streaming and sinks
    o["ingest_stream"] = with_(BT + STORE, """SELECT title_hash, title, source FROM store
UNION ALL
SELECT title_hash, coalesce(title, '') AS title, coalesce(source, '') AS source FROM (
  SELECT *, row_number() OVER (PARTITION BY title_hash ORDER BY pos) AS rn FROM (
    SELECT *, md5(coalesce(title, '') || coalesce(description, '')) AS title_hash FROM articles))
WHERE rn = 1 AND title_hash NOT IN (SELECT title_hash FROM store)""")
    clean = lambda c: trim(f"regexp_replace({c}, {bad}, '', 'g')")
    o["ingest_feeds"] = with_(BT + STORE, f"""SELECT title_hash, title, source FROM store
UNION ALL
SELECT title_hash, title, source FROM (
  SELECT *, row_number() OVER (PARTITION BY title_hash ORDER BY pos // 100, source || '/', pos) AS rn FROM (
    SELECT *, md5(title || description) AS title_hash FROM (
      SELECT pos, source, {clean('title')} AS title, {clean("coalesce(description, '')")} AS description FROM articles)))
WHERE rn = 1 AND title_hash NOT IN (SELECT title_hash FROM store)""")
    ranges = [*BT, *STORE, *rel_all[len(BT):], """merged AS (
  SELECT title_hash, id, title, source, category, is_relevant FROM store
  UNION ALL
  SELECT title_hash, NULL, coalesce(title, ''), coalesce(source, ''), NULL, true FROM (
    SELECT *, row_number() OVER (PARTITION BY title_hash ORDER BY pos) AS rn FROM (
      SELECT *, md5(coalesce(title, '') || coalesce(description, '')) AS title_hash FROM articles))
  WHERE rn = 1 AND title_hash NOT IN (SELECT title_hash FROM store)),
updated AS (
  SELECT m.* EXCLUDE (is_relevant), CASE WHEN r.article_id IS NOT NULL THEN r.is_relevant ELSE m.is_relevant END AS is_relevant,
    r.relevance_confidence FROM merged m LEFT JOIN rel r ON CAST(r.article_id AS VARCHAR) = m.id)"""]
    o["store_ranges"] = with_(ranges, f"""SELECT title_hash, id, title, source, is_relevant,
  {r6('relevance_confidence')} AS relevance_confidence FROM updated""")
    o["store_ranges_stats"] = with_(ranges, "SELECT category, source, is_relevant, count(*) AS count FROM updated GROUP BY ALL")
    own = [f"md5(coalesce({c}, '')) AS {p}_{c}" for p in ("csv", "json")
           for c in ("title", "description", "source", "category")]
    o["sink_roundtrip"] = with_(BASE_VEC, f"""SELECT article_id, {', '.join(own)}, (SELECT count(*) FROM articles) AS total_articles,
  true AS text_has_footer FROM nearest""")
    o["method_files"] = with_([MR], "SELECT method, count(*) AS count FROM mr GROUP BY method")
    return o

