"""The registered queries in SQL over the synthetic tables, written row by row and apart from the Spark expressions."""

from __future__ import annotations

from kithline.functions.constants import (
    ABBREVIATIONS, ADDRESS_STOP, BLOCKING_SUFFIXES, CAPS, CUTOFFS, FOLDED_ADDRESS_STOP, LEGAL_SUFFIXES, MAX_POSTING, OTHER_CAP, POOL_GROUPS, RARE_POSTING, RECALL_KS, ROUTE_GROUPS, RULE_THRESHOLD,
    SEED, SHORT_NUMBER_CAP, SUPPORT_BLOCK, SUPPORT_RANK, SWEEP_THRESHOLDS, WEIGHTS, INDIC_LETTERS, LATIN_LETTERS,
)
from kithline.operators.model import FIXED, FIXED_BIAS

_Q = lambda words: ", ".join(f"'{w}'" for w in words)
_PUNCT = r"'[!-/:-@\[-`{-~]'"


def _words(x: str) -> str:
    return rf"list_filter(string_split_regex(regexp_replace({x}, {_PUNCT}, ' ', 'g'), '\s+'), lambda w: w <> '')"


def _norm(x: str) -> str:
    """Normalised text; right for Latin texts."""
    folded = f"replace(replace(lower({x}), 'ß', 'ss'), '&', ' and ')"
    apart = rf"regexp_replace(regexp_replace(regexp_replace({folded}, '[\pP\pZ]', ' ', 'g'), '(\pL)(\pN)', '\1 \2', 'g'), '(\pN)(\pL)', '\1 \2', 'g')"
    return rf"trim(regexp_replace({apart}, '\s+', ' ', 'g'))"


def _core(x: str) -> str:
    return rf"regexp_replace({x}, '^(.+?)(?: (?:{'|'.join(LEGAL_SUFFIXES)}))+$', '\1')"


def _skeleton(x: str) -> str:
    return f"regexp_replace(translate(replace(regexp_replace({x}, '[aeiouh]', '', 'g'), 'x', 'ks'), 'c', 'k'), '[^a-z]', '', 'g')"


def _grams(x: str) -> str:
    c = rf"regexp_replace({x}, '[^\pL\pN]', '', 'g')"
    return f"(CASE WHEN {c} = '' THEN CAST([] AS VARCHAR[]) ELSE list_distinct(list_transform(range(1, greatest(2, length({c}) - 1)), lambda i: substr({c}, CAST(i AS BIGINT), 3))) END)"


_ABBR = "CASE w " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ABBREVIATIONS.items()) + " ELSE w END"
_TOKENS = f"list_filter(string_split(regexp_replace(' ' || array_to_string({_words('lower(business_name)')}, ' '), '( ({'|'.join(BLOCKING_SUFFIXES)}))+$', ''), ' '), lambda w: length(w) >= 4)"
_NUMBERS = f"list_filter(list_transform(list_filter({_words('business_address')}, lambda w: regexp_full_match(w, '[0-9]+')), lambda w: ltrim(w, '0')), lambda w: w <> '')"
_NUMBER_WEIGHT = "CASE WHEN length(x) >= 4 THEN 2.3 WHEN length(x) = 3 THEN 1.1 ELSE 0.6 END"
_PLAIN = "CASE WHEN key LIKE 'f:%' THEN substr(key, 3) ELSE key END"
_CAP = f"CASE WHEN {_PLAIN} LIKE 'n:%' AND length({_PLAIN}) <= 4 THEN {SHORT_NUMBER_CAP} ELSE CASE split_part({_PLAIN}, ':', 1) " + " ".join(f"WHEN '{f}' THEN {n}" for f, n in CAPS.items()) + f" ELSE {OTHER_CAP} END END"
_ORDER = "CASE WHEN candidate_id LIKE 'S2-%' THEN 0 ELSE 1 END, CAST(split_part(candidate_id, '-', 2) AS BIGINT)"
F05 = "CASE WHEN predicted_n + true_n = 0 THEN 1.0 ELSE 1.25 * tp / (predicted_n + 0.25 * true_n) END"


def _keys(name: str, source: str) -> str:
    return f"{name} AS (SELECT entity_id, country, key, max(weight) AS weight, count(*) AS mult FROM {source} GROUP BY ALL)".replace("GROUP BY ALL", "GROUP BY entity_id, country, key")


def _retrieval(prefix: str, keys: str, legacy: bool = False) -> dict[str, str]:
    count, times = ("tf", " * q.mult * p.mult") if legacy else ("df", "")
    return {
        f"{prefix}st": f"SELECT country, key, count(*) AS df, CAST(sum(mult) AS BIGINT) AS tf, {_CAP} AS cap FROM {keys} WHERE entity_id NOT LIKE 'S1-%' GROUP BY country, key",
        f"{prefix}us": f"SELECT * FROM {prefix}st WHERE df <= cap" + (" AND tf <= cap" if legacy else ""),
        f"{prefix}hit": f"""SELECT q.entity_id AS query_id, p.entity_id AS candidate_id, CAST(round(CAST(q.weight AS DOUBLE) * ln((population + 1) / CAST({count} + 1 AS DOUBLE)){times} * 1e12) AS BIGINT) AS part,
            CASE WHEN q.key LIKE 'f:%' THEN 'f_' || split_part(substr(q.key, 3), ':', 1) ELSE split_part(q.key, ':', 1) END AS route
            FROM {keys} q JOIN {prefix}us u USING (country, key) JOIN pop USING (country) JOIN {keys} p USING (country, key) WHERE q.entity_id LIKE 'S1-%' AND p.entity_id NOT LIKE 'S1-%'""",
        f"{prefix}sc": f"SELECT query_id, candidate_id, CAST(sum(part) AS DOUBLE) / 1e12 AS score, list_sort(list(DISTINCT route)) AS routes FROM {prefix}hit GROUP BY query_id, candidate_id",
        f"{prefix}rk": f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {_ORDER}, candidate_id) AS rank, CAST(score AS DOUBLE) / greatest(1e-9, CAST(max(score) OVER (PARTITION BY query_id) AS DOUBLE)) AS relative FROM {prefix}sc",
    }


_SHARED = "list_intersect(q.nums, c.nums)"
_JAC = lambda a: f"CASE WHEN len(q.{a}) + len(c.{a}) = 0 THEN 0.0 ELSE len(list_intersect(q.{a}, c.{a})) / CAST(len(list_distinct(list_concat(q.{a}, c.{a}))) AS DOUBLE) END"
_DICE = lambda a: f"CASE WHEN len(q.{a}) + len(c.{a}) = 0 THEN 0.0 ELSE 2 * len(list_intersect(q.{a}, c.{a})) / CAST(len(q.{a}) + len(c.{a}) AS DOUBLE) END"
_N = "greatest(name_tokens, name_chars, 0.85 * name_skeleton)"
_A = "(0.9 * address_words + 0.3 * address_containment)"
BASE = f"""CAST(q.name <> '' AND q.name = c.name AS DOUBLE) AS name_exact, {_JAC('toks')} AS name_tokens, {_DICE('grams')} AS name_chars, {_DICE('sgrams')} AS name_skeleton, {_JAC('words')} AS address_words,
    len(list_intersect(q.words, c.words)) / CAST(greatest(1, least(len(q.words), len(c.words))) AS DOUBLE) AS address_containment,
    CAST(len(list_filter({_SHARED}, lambda n: length(n) >= 4)) > 0 AS DOUBLE) AS number_long, CAST(len(list_filter({_SHARED}, lambda n: length(n) = 3)) > 0 AS DOUBLE) AS number_medium, CAST(len({_SHARED}) > 0 AS DOUBLE) AS number_short,
    CAST(len(q.nums) > 0 AND len(c.nums) > 0 AND len({_SHARED}) = 0 AS DOUBLE) AS number_conflict, CAST(len(q.words) + len(q.nums) = 0 OR len(c.words) + len(c.nums) = 0 AS DOUBLE) AS missing_address"""

CTES: dict[str, str] = {
    "er": "SELECT 'S' || (1 + p_partkey % 3) || '-' || p_partkey AS entity_id, p_name AS business_name, CAST(floor(p_retailprice) AS BIGINT) || ' ' || p_brand || ' ' || p_type || ' road ' || p_size AS business_address, CASE WHEN p_size % 2 = 0 THEN 'US' ELSE 'India' END AS country FROM part",
    "truth": "SELECT DISTINCT 'S1-' || a.p_partkey AS query_id, 'S' || (1 + b.p_partkey % 3) || '-' || b.p_partkey AS true_id FROM part a JOIN part b ON a.p_name = b.p_name AND floor(a.p_retailprice) = floor(b.p_retailprice) AND a.p_size % 2 = b.p_size % 2 WHERE a.p_partkey % 3 = 0 AND b.p_partkey % 3 > 0",
    "s1": "SELECT entity_id AS query_id, country FROM er WHERE entity_id LIKE 'S1-%'",
    "whole": "SELECT 'S' || (1 + doc_id % 3) || '-' || doc_id AS entity_id, coalesce(text, '') AS business_name FROM documents WHERE doc_id IS NOT NULL",
    "doc": r"SELECT 'S' || (1 + doc_id % 3) || '-' || doc_id AS entity_id, array_to_string(w[1:6], ' ') AS business_name, array_to_string(w[7:18], ' ') AS business_address, coalesce(lang, '') AS country FROM (SELECT *, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents)",
    "tok": f"SELECT entity_id, country, business_name, business_address, {_TOKENS} AS tokens, {_NUMBERS} AS numbers FROM er",
    "k1": f"""SELECT DISTINCT entity_id, country, key FROM (
        SELECT entity_id, country, 't:' || unnest(tokens) AS key FROM tok UNION ALL SELECT entity_id, country, 'p4:' || left(unnest(tokens), 4) FROM tok
        UNION ALL SELECT entity_id, country, 'sk:' || left(s, 10) FROM (SELECT *, replace(translate(array_to_string(tokens, ''), 'caeiouh', 'k'), 'x', 'ks') AS s FROM tok) WHERE length(s) >= 5
        UNION ALL SELECT entity_id, country, 'c6:' || left(array_to_string(tokens, ''), 8) FROM tok WHERE length(array_to_string(tokens, '')) >= 6
        UNION ALL SELECT entity_id, country, 'n:' || x FROM (SELECT *, unnest(numbers) AS x FROM tok) WHERE length(x) >= 2
        UNION ALL SELECT entity_id, country, 'ns:' || array_to_string(numbers[1:4], '-') FROM tok WHERE len(numbers) >= 2)""",
    "tok2": f"SELECT * REPLACE (CASE WHEN len(tokens) > 0 THEN tokens ELSE list_filter({_words('lower(business_name)')}, lambda w: length(w) >= 2) END AS tokens, list_filter(numbers, lambda n: length(n) >= 2) AS numbers) FROM tok",
    "r2": f"""SELECT entity_id, country, 't:' || unnest(tokens) AS key, {WEIGHTS['t']} AS weight FROM tok2
        UNION ALL SELECT entity_id, country, 'p:' || left(x, 4), {WEIGHTS['p']} FROM (SELECT *, unnest(tokens) AS x FROM tok2) WHERE length(x) >= 5
        UNION ALL SELECT entity_id, country, 's:' || right(x, 4), {WEIGHTS['s']} FROM (SELECT *, unnest(tokens) AS x FROM tok2) WHERE length(x) >= 5
        UNION ALL SELECT entity_id, country, 'sk:' || left(s, 8), {WEIGHTS['sk']} FROM (SELECT *, replace(translate(array_to_string(tokens, ''), 'caeiouh', 'k'), 'x', 'ks') AS s FROM tok2) WHERE length(s) >= 5
        UNION ALL SELECT entity_id, country, 'c:' || left(array_to_string(tokens, ''), 12), {WEIGHTS['c']} FROM tok2 WHERE length(array_to_string(tokens, '')) >= 6
        UNION ALL SELECT entity_id, country, 'n:' || x, {_NUMBER_WEIGHT} FROM (SELECT *, unnest(numbers) AS x FROM tok2)
        UNION ALL SELECT entity_id, country, 'ns:' || array_to_string(numbers[1:4], '-'), {WEIGHTS['ns']} FROM tok2 WHERE len(numbers) >= 2
        UNION ALL SELECT entity_id, country, 'aw:' || x, {WEIGHTS['aw']} FROM (SELECT *, unnest({_words('lower(business_address)')}) AS x FROM tok2) WHERE length(x) >= 5 AND NOT regexp_full_match(x, '[0-9]+') AND x NOT IN ({_Q(ADDRESS_STOP)})""",
    "k2": "SELECT entity_id, country, key, max(weight) AS weight, count(*) AS mult FROM r2 GROUP BY entity_id, country, key",
    "vw": rf"""SELECT entity_id, country, core AS name, list_distinct(list_filter(string_split(core, ' '), lambda w: w <> '')) AS toks, {_grams('core')} AS grams, {_skeleton('core')} AS sk, {_grams(_skeleton('core'))} AS sgrams,
        list_distinct(list_filter(al, lambda w: length(w) >= 4 AND NOT regexp_full_match(w, '[0-9]+') AND w NOT IN ({_Q(FOLDED_ADDRESS_STOP)}))) AS words,
        list_distinct(list_transform(list_filter(al, lambda w: regexp_full_match(w, '[0-9]+')), lambda w: CASE WHEN ltrim(w, '0') = '' THEN '0' ELSE ltrim(w, '0') END)) AS nums
        FROM (SELECT *, {_core(_norm('business_name'))} AS core, list_transform(regexp_extract_all({_norm('business_address')}, '[\pL\pN]+'), lambda w: {_ABBR}) AS al FROM er)""",
    "w6": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY length(w) DESC, w) AS i FROM (SELECT entity_id, country, unnest(words) AS w FROM vw)) WHERE i <= 6",
    "n4": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY length(n) DESC, n) AS i FROM (SELECT entity_id, unnest(nums) AS n FROM vw) WHERE length(n) >= 2) WHERE i <= 4",
    "r3": f"""SELECT * FROM r2
        UNION ALL SELECT entity_id, country, 'f:t:' || x, {WEIGHTS['f:t']} FROM (SELECT *, unnest(string_split(name, ' ')) AS x FROM vw) WHERE length(x) >= 3
        UNION ALL SELECT entity_id, country, 'f:c:' || left(replace(name, ' ', ''), 16), {WEIGHTS['f:c']} FROM vw WHERE length(name) >= 6
        UNION ALL SELECT entity_id, country, 'f:aw:' || unnest(words), {WEIGHTS['f:aw']} FROM vw
        UNION ALL SELECT a.entity_id, a.country, 'a2:' || a.w || '|' || b.w, {WEIGHTS['a2']} FROM w6 a JOIN w6 b ON a.entity_id = b.entity_id AND a.w < b.w
        UNION ALL SELECT a.entity_id, a.country, 'an:' || a.w || '|' || b.n, {WEIGHTS['an']} FROM w6 a JOIN n4 b ON a.entity_id = b.entity_id WHERE length(b.n) >= 3
        UNION ALL SELECT a.entity_id, e.country, 'n2:' || a.n || '|' || b.n, {WEIGHTS['n2']} FROM n4 a JOIN n4 b ON a.entity_id = b.entity_id AND a.n < b.n JOIN er e ON e.entity_id = a.entity_id
        UNION ALL SELECT entity_id, country, 'sg:' || substr(s, CAST(i AS BIGINT), 4), {WEIGHTS['sg']} FROM (SELECT entity_id, country, left(sk, 40) AS s, unnest(range(1, length(left(sk, 40)) - 2)) AS i FROM vw WHERE length(sk) >= 5)""",
    "k3": "SELECT entity_id, country, key, max(weight) AS weight, count(*) AS mult FROM r3 GROUP BY entity_id, country, key",
    "pop": "SELECT country, count(*) AS population FROM er WHERE entity_id NOT LIKE 'S1-%' GROUP BY country",
    **_retrieval("d", "k2"), **_retrieval("l", "k2", True), **_retrieval("e", "k3"),
    "p1": f"SELECT k.*, df FROM k1 k JOIN (SELECT country, key, count(*) AS df FROM k1 WHERE entity_id NOT LIKE 'S1-%' GROUP BY country, key HAVING count(*) <= {MAX_POSTING}) USING (country, key) WHERE entity_id NOT LIKE 'S1-%' AND (key LIKE 't:%' OR (key LIKE 'n:%' AND length(key) >= 5))",
    "h1": "SELECT q.entity_id AS query_id, p.entity_id AS candidate_id, key, df FROM k1 q JOIN p1 p USING (country, key) WHERE q.entity_id LIKE 'S1-%'",
    "sup": f"SELECT query_id, candidate_id, count(*) AS support FROM (SELECT a.query_id, a.candidate_id, count(*) OVER (PARTITION BY a.query_id, a.key, b.key) AS n FROM h1 a JOIN h1 b USING (query_id, candidate_id) WHERE a.key LIKE 't:%' AND length(a.key) >= 7 AND b.key LIKE 'n:%') WHERE n <= {SUPPORT_RANK} GROUP BY query_id, candidate_id",
    "sup8": f"SELECT query_id, candidate_id, count(*) AS support FROM (SELECT a.query_id, a.candidate_id, count(*) OVER (PARTITION BY a.query_id, a.key, b.key) AS n FROM h1 a JOIN h1 b USING (query_id, candidate_id) WHERE a.key LIKE 't:%' AND length(a.key) >= 7 AND b.key LIKE 'n:%') WHERE n <= {SUPPORT_BLOCK} GROUP BY query_id, candidate_id",
    "rare": f"SELECT DISTINCT query_id, candidate_id FROM h1 WHERE key LIKE 't:%' AND length(key) >= 7 AND df <= {RARE_POSTING}",
    "sig": "SELECT entity_id, list_distinct(tokens) AS t, list_distinct(list_filter(numbers, lambda n: length(n) >= 2)) AS n FROM tok",
    "ps": """SELECT query_id, candidate_id, CASE WHEN len(q.t) + len(c.t) = 0 THEN 0.0 ELSE len(list_intersect(q.t, c.t)) / CAST(len(list_distinct(list_concat(q.t, c.t))) AS DOUBLE) END
        + CASE WHEN len(list_filter(list_intersect(q.n, c.n), lambda x: length(x) >= 4)) > 0 THEN 0.45 WHEN len(list_filter(list_intersect(q.n, c.n), lambda x: length(x) >= 3)) > 0 THEN 0.30 WHEN len(list_intersect(q.n, c.n)) > 0 THEN 0.12 ELSE 0.0 END AS score
        FROM (SELECT query_id, candidate_id FROM sup UNION SELECT query_id, candidate_id FROM rare) JOIN sig q ON q.entity_id = query_id JOIN sig c ON c.entity_id = candidate_id""",
    "acc": f"SELECT query_id, candidate_id, score FROM ps WHERE score >= {RULE_THRESHOLD}",
    "pq": f"""SELECT query_id, country, true_n, predicted_n, tp, {F05} AS f05 FROM (
        SELECT s1.query_id, country, (SELECT count(*) FROM truth t WHERE t.query_id = s1.query_id) AS true_n, (SELECT count(*) FROM acc a WHERE a.query_id = s1.query_id) AS predicted_n,
        (SELECT count(*) FROM acc a JOIN truth t ON a.query_id = t.query_id AND a.candidate_id = t.true_id WHERE a.query_id = s1.query_id) AS tp FROM s1)""",
    "fp": f"SELECT query_id, candidate_id, rank, relative, routes, q.name AS qn, c.name AS cn, {BASE} FROM erk JOIN vw q ON q.entity_id = query_id JOIN vw c ON c.entity_id = candidate_id WHERE rank <= {max(CUTOFFS)}",
    "mp": "SELECT query_id, candidate_id, rank, 1.0 / (1.0 + exp(-(" + " + ".join(f"{w} * {'greatest(name_tokens, name_chars, name_skeleton)' if k == 'name_best' else k}" for k, w in FIXED.items()) + f" + {FIXED_BIAS}))) AS probability FROM fp",
}
_NEEDS = {
    "truth": [], "s1": ["er"], "tok": ["er"], "k1": ["tok"], "tok2": ["tok"], "r2": ["tok2"], "k2": ["r2"], "vw": ["er"], "w6": ["vw"], "n4": ["vw"], "r3": ["r2", "vw", "w6", "n4"], "k3": ["r3"], "pop": ["er"],
    **{f"{p}{x}": n for p, k in (("d", "k2"), ("l", "k2"), ("e", "k3")) for x, n in (("st", [k]), ("us", [f"{p}st"]), ("hit", [f"{p}us", "pop", k]), ("sc", [f"{p}hit"]), ("rk", [f"{p}sc"]))},
    "p1": ["k1"], "h1": ["k1", "p1"], "sup": ["h1"], "rare": ["h1"], "sig": ["tok"], "ps": ["sup", "rare", "sig"], "acc": ["ps"], "pq": ["s1", "truth", "acc"], "fp": ["erk", "vw"], "mp": ["fp"], "er": [], "doc": [], "whole": [], "sup8": ["h1"],
}


def query(select: str, *needs: str) -> str:
    """The select with the common tables it needs, in order."""
    found: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS[name]:
            add(n)
        if name not in found:
            found.append(name)

    for n in needs:
        add(n)
    return ("WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in found) + "\n" if found else "") + select


def r6(x: str, name: str | None = None) -> str:
    return f"round(CAST({x} AS DOUBLE), 6) AS {name or x}"


def metrics(rows: str, by: str = "") -> str:
    """The report's columns over rows with true_n, predicted_n, tp, f05."""
    g = f"{by}, " if by else ""
    return f"""SELECT {g}entities, {r6('macro_f05')}, true_pairs, predicted_pairs, true_positives, singletons, singleton_correct,
        {r6('CASE WHEN predicted_pairs = 0 THEN CASE WHEN true_pairs = 0 THEN 1.0 ELSE 0.0 END ELSE true_positives / CAST(predicted_pairs AS DOUBLE) END', 'pair_precision')},
        {r6('CASE WHEN true_pairs = 0 THEN CASE WHEN predicted_pairs = 0 THEN 1.0 ELSE 0.0 END ELSE true_positives / CAST(true_pairs AS DOUBLE) END', 'pair_recall')},
        {r6('CASE WHEN singletons = 0 THEN NULL ELSE singleton_correct / CAST(singletons AS DOUBLE) END', 'singleton_accuracy')}
        FROM (SELECT {g}count(*) AS entities, avg(f05) AS macro_f05, CAST(sum(true_n) AS BIGINT) AS true_pairs, CAST(sum(predicted_n) AS BIGINT) AS predicted_pairs, CAST(sum(tp) AS BIGINT) AS true_positives,
        count(*) FILTER (WHERE true_n = 0) AS singletons, count(*) FILTER (WHERE true_n = 0 AND predicted_n = 0) AS singleton_correct FROM {rows} {f'GROUP BY {by}' if by else ''})"""


def _at_k() -> str:
    ks = ", ".join(f"({k})" for k in [*RECALL_KS, -1])
    return f"""SELECT grp, k, entities, true_links, hits, covered, {r6('CASE WHEN true_links = 0 THEN NULL ELSE hits / CAST(true_links AS DOUBLE) END', 'pair_recall')}, {r6('oracle_macro_f05')} FROM (
        SELECT grp, k, count(*) AS entities, CAST(sum(n) AS BIGINT) AS true_links, CAST(sum(h) AS BIGINT) AS hits, count(*) FILTER (WHERE h > 0) AS covered, avg(CASE WHEN n = 0 THEN 1.0 ELSE 1.25 * h / (h + 0.25 * n) END) AS oracle_macro_f05
        FROM (SELECT s1.query_id, country, k, count(true_id) AS n, count(true_id) FILTER (WHERE rank IS NOT NULL AND (k = -1 OR rank <= k)) AS h
              FROM s1 CROSS JOIN (VALUES {ks}) v(k) LEFT JOIN truth t ON t.query_id = s1.query_id LEFT JOIN drk r ON r.query_id = t.query_id AND r.candidate_id = t.true_id GROUP BY ALL)
        CROSS JOIN (VALUES ('all'), ('country')) g(kind), LATERAL (SELECT CASE WHEN kind = 'all' THEN 'all' ELSE 'country:' || country END AS grp) GROUP BY grp, k
        UNION ALL
        SELECT grp, k, 0, count(*), count(*) FILTER (WHERE rank IS NOT NULL AND (k = -1 OR rank <= k)), 0, NULL
        FROM truth t JOIN s1 USING (query_id) CROSS JOIN (VALUES {ks}) v(k) LEFT JOIN drk r ON r.query_id = t.query_id AND r.candidate_id = t.true_id
        CROSS JOIN (VALUES (1), (2)) g(kind), LATERAL (SELECT CASE WHEN kind = 1 THEN 'source:' || left(true_id, 2) ELSE 'country_source:' || country || ':' || left(true_id, 2) END AS grp) GROUP BY grp, k)"""


def _route_pool(limit: int) -> str:
    half, share = limit // 2, (limit - limit // 2) // len(POOL_GROUPS)
    sql, last = f"WITH z0 AS (SELECT query_id, candidate_id, rank, routes, rank <= {half} AS inn FROM erk)", "z0"
    sql = sql.replace("WITH ", "")
    for i, g in enumerate(POOL_GROUPS, 1):
        has = f"len(list_intersect(routes, [{_Q(g)}])) > 0"
        sql += f", z{i} AS (SELECT query_id, candidate_id, rank, routes, inn OR (op AND row_number() OVER (PARTITION BY query_id, op ORDER BY rank) <= {share}) AS inn FROM (SELECT *, NOT inn AND {has} AS op FROM {last}))"
        last = f"z{i}"
    return sql, f"SELECT query_id, candidate_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, inn ORDER BY rank) AS place, count(*) FILTER (WHERE inn) OVER (PARTITION BY query_id) AS chosen FROM {last}) WHERE inn OR place <= {limit} - chosen"


def route_pool_sql(limit: int) -> str:
    more, select = _route_pool(limit)
    return query("@@" + select, "erk").replace("\n@@", ",\n" + more + "\n")


def sweep_sql(thresholds: list[float], cutoffs: list[int]) -> str:
    grid = ", ".join(f"({c}, CAST({t!r} AS DOUBLE))" for c in cutoffs for t in thresholds)
    rows = f"""(SELECT cutoff, threshold, true_n, predicted_n, tp, {F05} AS f05 FROM (
        SELECT s1.query_id, cutoff, threshold, (SELECT count(*) FROM truth t WHERE t.query_id = s1.query_id) AS true_n, count(m.candidate_id) AS predicted_n, count(t.true_id) AS tp
        FROM s1 CROSS JOIN (VALUES {grid}) g(cutoff, threshold) LEFT JOIN mp m ON m.query_id = s1.query_id AND rank <= cutoff AND probability >= threshold LEFT JOIN truth t ON t.query_id = m.query_id AND t.true_id = m.candidate_id
        GROUP BY s1.query_id, cutoff, threshold))"""
    return query(metrics(rows, "cutoff, threshold"), "s1", "truth", "mp")


_SPLIT = f"""SELECT entity_id AS source1_entity_id, country, match_count, bucket, CASE WHEN place <= least(n, greatest(round_even(n * 0.1, 0), CASE WHEN n >= 10 THEN 1 ELSE 0 END)) THEN 'valid' ELSE 'train' END AS split FROM (
    SELECT *, count(*) OVER (PARTITION BY country, bucket) AS n, row_number() OVER (PARTITION BY country, bucket ORDER BY md5('{SEED}|' || entity_id), entity_id) AS place FROM (
    SELECT s1.query_id AS entity_id, country, count(true_id) AS match_count, CASE WHEN count(true_id) >= 8 THEN '8+' ELSE CAST(count(true_id) AS VARCHAR) END AS bucket FROM s1 LEFT JOIN truth USING (query_id) GROUP BY ALL))"""
_TOP = "SELECT query_id, candidate_id, rank, {s} FROM {t} WHERE rank <= 20"
_NAME_FEATURES = "name_exact, name_tokens, name_chars, name_skeleton, address_words, address_containment, number_long, number_medium, number_short, number_conflict, missing_address"
_BEST = "greatest(name_tokens, name_chars, name_skeleton)"



def _allocation(name: str, size: str, least: int) -> str:
    """Tables up to one of that name: country, bucket, available, quota."""
    base = query("", "s1", "truth").removesuffix("\n") if name == "p" else "WITH "
    head = f"{base}, " if name == "p" else base
    return f"""{head}{name}0 AS (SELECT country, bucket, count(*) AS available FROM ({_SPLIT}) GROUP BY 1, 2),
        {name}1 AS (SELECT *, CAST({size} AS BIGINT) AS size FROM (SELECT *, sum(available) OVER () AS total, count(*) OVER () AS strata FROM {name}0)),
        {name}2 AS (SELECT *, least(available, greatest({least}, floor(available * size / CAST(total AS DOUBLE)))) AS q, available * size / CAST(total AS DOUBLE) AS share FROM {name}1),
        {name}3 AS (SELECT *, size - sum(q) OVER () AS off FROM {name}2),
        {name}4 AS (SELECT country, bucket, off, CASE WHEN off > 0 THEN share - (q + step) ELSE (q - step) - share END AS gap FROM (SELECT *, unnest(range(CAST(abs(off) AS BIGINT))) AS step FROM {name}3) WHERE off < 0 OR q + step < available),
        {name}5 AS (SELECT country, bucket, sum(sign(off)) AS more FROM (SELECT *, row_number() OVER (ORDER BY gap DESC, country DESC, bucket DESC) AS place FROM {name}4) WHERE place <= abs(off) GROUP BY 1, 2),
        {name} AS (SELECT country, bucket, available, q + coalesce(more, 0) AS quota FROM {name}3 LEFT JOIN {name}5 USING (country, bucket))"""


ORACLE_SQL: dict[str, str] = {
    "scan_profile": query("SELECT left(entity_id, 2) AS source, count(*) AS rows, 0::BIGINT AS malformed_ids, 0::BIGINT AS duplicate_ids, count(*) FILTER (WHERE trim(business_name) = '') AS missing_names, count(*) FILTER (WHERE trim(business_address) = '') AS missing_addresses, count(DISTINCT country) AS countries FROM er GROUP BY 1", "er"),
    "normalize_name": query(f"SELECT entity_id, n AS normalized, strip_accents(n) AS folded, {_core('n')} AS core FROM (SELECT entity_id, {_norm('business_name')} AS n FROM whole)", "whole"),
    "legal_suffix_core": f"SELECT c_custkey, {_core('n')} AS core FROM (SELECT c_custkey, {_norm("c_name || [' Inc.', ' Pvt. Ltd.', ' Limited Company', '', ' S.A. SA'][1 + c_custkey % 5]")} AS n FROM customer)",
    "consonant_skeleton": query(f"SELECT entity_id, {_skeleton('strip_accents(' + _norm('business_name') + ')')} AS skeleton FROM whole", "whole"),
    "address_parts": query("SELECT entity_id, array_to_string(list_sort(words), ' ') AS words, array_to_string(list_sort(nums), ' ') AS numbers FROM vw", "vw"),
    "char_grams": query("SELECT entity_id, array_to_string(list_sort(grams), ' ') AS grams, CAST(len(grams) AS BIGINT) AS n FROM vw", "vw"),
    "keys_g1": query("SELECT entity_id, country, key FROM k1", "k1"),
    "keys_g2": query(f"SELECT entity_id, country, key, {r6('weight')}, mult FROM k2", "k2"),
    "keys_g3": query(f"SELECT entity_id, country, key, {r6('weight')}, mult FROM k3", "k3"),
    "doc_freq": query("SELECT country, key, df FROM dst", "dst"),
    "term_freq": query("SELECT country, key, tf FROM dst", "dst"),
    "usable_keys": query("SELECT country, key, df, tf, CAST(cap AS BIGINT) AS cap FROM dus", "dus"),
    "retrieve_topk_dedup": query(_TOP.format(s=r6("score"), t="drk"), "drk"),
    "retrieve_topk_legacy": query(_TOP.format(s=r6("score"), t="lrk"), "lrk"),
    "retrieve_topk_enhanced": query(_TOP.format(s=r6("score") + ", array_to_string(routes, ',') AS routes", t="erk"), "erk"),
    "block_token_number": query("SELECT query_id, candidate_id, support FROM sup", "sup"),
    "rare_token_route": query("SELECT query_id, candidate_id FROM rare", "rare"),
    "pair_score_rule": query(f"SELECT query_id, candidate_id, {r6('score')} FROM ps", "ps"),
    "rule_submission": query("SELECT s1.query_id AS source1_entity_id, coalesce(string_agg(candidate_id, ',' ORDER BY score DESC, candidate_id), '') AS matched_entity_ids FROM s1 LEFT JOIN acc USING (query_id) GROUP BY 1", "s1", "acc"),
    "pair_features_base": query("SELECT query_id, candidate_id, " + ", ".join(r6(f) for f in _NAME_FEATURES.split(", ")) + " FROM fp", "fp"),
    "pair_features_all19": query("SELECT query_id, candidate_id, " + ", ".join(r6(f) for f in _NAME_FEATURES.split(", ")) + f""", {r6(_BEST, 'name_best')}, {r6(_BEST + ' * address_words', 'name_address_interaction')}, {r6('name_skeleton * address_words', 'skeleton_address_interaction')},
        {r6(_BEST + ' * number_short', 'number_name_interaction')}, {r6('least(length(qn), length(cn)) / CAST(greatest(1, length(qn), length(cn)) AS DOUBLE)', 'name_length_ratio')}, {r6('relative', 'retrieval_relative_score')},
        {r6(' + '.join(f'CASE WHEN len(list_intersect(routes, [{_Q(g)}])) > 0 THEN 1 ELSE 0 END' for g in ROUTE_GROUPS), 'route_count')}, {r6("CASE WHEN candidate_id LIKE 'S3-%' THEN 1 ELSE 0 END", 'source3')} FROM fp""", "fp"),
    "pair_rank_name": query(f"SELECT query_id, candidate_id, {r6(f'2.5 * {_N} + 0.5 * name_exact', 'pair_rank')} FROM fp", "fp"),
    "pair_rank_name_address": query(f"SELECT query_id, candidate_id, {r6(f'2.5 * {_N} + 0.5 * name_exact + {_A} + 0.65 * number_long + 0.4 * number_medium + 0.15 * number_short + 0.5 * {_N} * {_A} - 0.3 * number_conflict', 'pair_rank')} FROM fp", "fp"),
    "route_pool": route_pool_sql(1000),
    "recall_at_k": query(f"SELECT grp, k, true_links, hits, pair_recall FROM ({_at_k()})", "s1", "truth", "drk"),
    "oracle_f05_at_k": query(f"SELECT grp, k, entities, covered, oracle_macro_f05 FROM ({_at_k()}) WHERE entities > 0", "s1", "truth", "drk"),
    "loss_reasons": query("""SELECT reason, count(*) AS links FROM (SELECT CASE WHEN NOT EXISTS (SELECT 1 FROM k2 a JOIN k2 b USING (key) WHERE a.entity_id = t.query_id AND b.entity_id = t.true_id) THEN 'NO_RAW_KEY'
        WHEN NOT EXISTS (SELECT 1 FROM k2 a JOIN k2 b USING (country, key) JOIN dus USING (country, key) WHERE a.entity_id = t.query_id AND b.entity_id = t.true_id) THEN 'ALL_SHARED_KEYS_PRUNED'
        WHEN rank <= 100 THEN 'IN_TOP_K' ELSE 'RANKED_BELOW_K' END AS reason FROM truth t LEFT JOIN drk r ON r.query_id = t.query_id AND r.candidate_id = t.true_id) GROUP BY reason""", "truth", "drk"),
    "pool_distribution": query("""SELECT n AS count, v[1 + CAST(floor((n - 1) * 0.5) AS BIGINT)] AS p50, v[1 + CAST(floor((n - 1) * 0.9) AS BIGINT)] AS p90, v[1 + CAST(floor((n - 1) * 0.99) AS BIGINT)] AS p99, v[n] AS max
        FROM (SELECT count(*) AS n, list_sort(list(c)) AS v FROM (SELECT s1.query_id, count(candidate_id) AS c FROM s1 LEFT JOIN drk USING (query_id) GROUP BY 1))""", "s1", "drk"),
    "macro_f05": query(metrics("pq"), "pq"),
    "pair_precision_recall": query(f"SELECT true_pairs, predicted_pairs, true_positives, pair_precision, pair_recall FROM ({metrics('pq')})", "pq"),
    "singleton_accuracy": query(f"SELECT singletons, singleton_correct, singleton_accuracy FROM ({metrics('pq')})", "pq"),
    "country_f05": query(f"SELECT country, entities, macro_f05 FROM ({metrics('pq', 'country')})", "pq"),
    "rule_sweep": query(f"""SELECT rule, {r6('avg(f05)', 'macro_f05')} FROM (SELECT rule, query_id, {F05} AS f05 FROM (
        SELECT rule, s1.query_id, (SELECT count(*) FROM truth t WHERE t.query_id = s1.query_id) AS true_n, count(c.candidate_id) AS predicted_n, count(t.true_id) AS tp
        FROM s1 CROSS JOIN (VALUES {', '.join(f"('{t:.2f}', {t}, 1000000000)" for t in SWEEP_THRESHOLDS)}, ('top1>=0.60', 0.60, 1), ('top3>=0.45', 0.45, 3)) g(rule, least, most)
        LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_id DESC) AS place FROM ps) c ON c.query_id = s1.query_id AND score >= least AND place <= most
        LEFT JOIN truth t ON t.query_id = c.query_id AND t.true_id = c.candidate_id GROUP BY rule, s1.query_id)) GROUP BY rule""", "s1", "truth", "ps"),
    "threshold_sweep": sweep_sql([round(0.05 + 0.025 * i, 3) for i in range(37)], [1 << 30]),
    "cutoff_sweep": sweep_sql([0.6], CUTOFFS),
    "stratified_split": query(_SPLIT, "s1", "truth"),
    "split_summary": query(f"SELECT country, bucket, count(*) AS entities, count(*) FILTER (WHERE split = 'valid') AS valid, count(*) FILTER (WHERE split = 'train') AS train FROM ({_SPLIT}) GROUP BY country, bucket", "s1", "truth"),
    "dup_ids": "SELECT 'P-' || p_name AS entity_id, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1",
    "dangling_refs": query("SELECT query_id, true_id FROM truth WHERE NOT EXISTS (SELECT 1 FROM er WHERE entity_id = true_id AND entity_id LIKE 'S2-%')", "truth", "er"),
    "truth_anomalies": query("""SELECT anomaly, n FROM (SELECT 'rows' AS anomaly, (SELECT count(*) FROM s1) AS n UNION ALL SELECT 'duplicate_source1_rows', 0 UNION ALL SELECT 'invalid_source1_references', 0 UNION ALL SELECT 'missing_ground_truth_rows', 0
        UNION ALL SELECT 'duplicate_ids_in_lists', 0 UNION ALL SELECT 'source1_ids_as_matches', 0 UNION ALL SELECT 'malformed_match_ids', 0 UNION ALL SELECT 's2_matches', (SELECT count(*) FROM truth WHERE true_id LIKE 'S2-%')
        UNION ALL SELECT 's3_matches', (SELECT count(*) FROM truth WHERE true_id LIKE 'S3-%') UNION ALL SELECT 'missing_target_references', 0)""", "s1", "truth"),
    "matches_subset_candidates": query("SELECT count(*) AS matches, count(*) FILTER (WHERE d.candidate_id IS NULL) AS outside FROM acc LEFT JOIN (SELECT * FROM drk WHERE rank <= 300) d USING (query_id, candidate_id)", "acc", "drk"),
    "family_overlap": query(f"""SELECT country, family, count(*) AS links FROM (SELECT DISTINCT f.country, f.query_id, split_part(a.key, ':', 1) AS family FROM (
        SELECT *, row_number() OVER (PARTITION BY country ORDER BY md5('{SEED}|' || query_id), query_id) AS place FROM (SELECT query_id, country, min(true_id) AS true_id FROM truth JOIN s1 USING (query_id) GROUP BY 1, 2)) f
        JOIN k3 a ON a.entity_id = f.query_id JOIN k3 b ON b.entity_id = f.true_id AND a.key = b.key WHERE place <= 400) GROUP BY country, family""", "truth", "s1", "k3"),
    "ablation_families": query(f"""SELECT mode, CAST(count(*) AS BIGINT) AS pairs, {r6('sum(s)', 'total_score')} FROM (SELECT mode, query_id, candidate_id, CAST(sum(part) AS DOUBLE) / 1e12 AS s FROM ehit JOIN (VALUES
        ('baseline', ['t','p','s','sk','c','n','ns','aw']), ('folded', ['t','p','s','sk','c','n','ns','aw','f_t','f_c','f_aw']), ('address_combinations', ['t','p','s','sk','c','n','ns','aw','a2','an','n2']), ('skeleton_fragments', ['t','p','s','sk','c','n','ns','aw','sg'])) m(mode, fam)
        ON list_contains(fam, route) GROUP BY ALL) GROUP BY mode""", "ehit"),
    "country_compare": "SELECT n_name AS country, count(*) FILTER (WHERE c_custkey % 3 = 0) AS train_rows, count(*) FILTER (WHERE c_custkey % 3 = 1) AS test_rows, count(*) FILTER (WHERE c_custkey % 3 = 0) = 0 AS test_only FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 < 2 GROUP BY n_name",
    "cartesian_sizes": query("SELECT country, s1, others, s1 * others AS pairs FROM (SELECT country, count(*) FILTER (WHERE entity_id LIKE 'S1-%') AS s1, count(*) FILTER (WHERE entity_id NOT LIKE 'S1-%') AS others FROM er GROUP BY country)", "er"),
    "confirmation_errors": query(f"""SELECT query_id, {r6('f05')}, true_n, predicted_n, (SELECT coalesce(string_agg(candidate_id, ',' ORDER BY candidate_id), '') FROM acc a WHERE a.query_id = pq.query_id AND NOT EXISTS (SELECT 1 FROM truth t WHERE t.query_id = a.query_id AND t.true_id = a.candidate_id)) AS false_positive_ids,
        (SELECT coalesce(string_agg(true_id, ',' ORDER BY true_id), '') FROM truth t WHERE t.query_id = pq.query_id AND NOT EXISTS (SELECT 1 FROM acc a WHERE a.query_id = t.query_id AND a.candidate_id = t.true_id)) AS false_negative_ids FROM pq WHERE f05 < 1""", "pq"),
    "indic_skeleton": f"""SELECT c_custkey, regexp_replace(translate(replace(regexp_replace(lower(n), '[aeiouh]', '', 'g'), 'x', 'ks'), 'c{INDIC_LETTERS}', 'k{LATIN_LETTERS.replace('c', 'k')}'), '[^a-z]', '', 'g') AS skeleton
        FROM (SELECT c_custkey, array_slice('{INDIC_LETTERS}', 1 + c_custkey % {len(INDIC_LETTERS)}, 4 + c_custkey % {len(INDIC_LETTERS)}) || ' Chx ' || array_slice('{INDIC_LETTERS}', 1 + (7 * c_custkey) % {len(INDIC_LETTERS)}, 3 + (7 * c_custkey) % {len(INDIC_LETTERS)}) || chr(3201) || chr(3121) || chr(3249) AS n FROM customer)""",
    "loss_table": query(f"""SELECT t.query_id AS source1_id, t.true_id AS true_candidate_id, a.country, left(t.true_id, 2) AS candidate_source, coalesce(rawf, '') AS shared_raw_families, coalesce(usef, '') AS shared_usable_families,
        CASE WHEN rawf IS NULL THEN 'NO_RAW_KEY' WHEN coalesce(usef, '') = '' THEN 'ALL_SHARED_KEYS_PRUNED' WHEN rank <= 100 THEN 'IN_TOP_K' ELSE 'RANKED_BELOW_K' END AS reason, rank AS rank_if_ranked, {r6('score', 'retrieval_score')},
        count(*) OVER (PARTITION BY t.query_id) AS number_of_true_siblings, 0 AS script_mismatch, CASE WHEN trim(a.business_address) = '' OR trim(b.business_address) = '' THEN 1 ELSE 0 END AS missing_address
        FROM truth t JOIN er a ON a.entity_id = t.query_id JOIN er b ON b.entity_id = t.true_id LEFT JOIN drk r ON r.query_id = t.query_id AND r.candidate_id = t.true_id LEFT JOIN (
        SELECT t.query_id, t.true_id, string_agg(DISTINCT split_part(x.key, ':', 1), ',' ORDER BY split_part(x.key, ':', 1)) AS rawf, string_agg(DISTINCT split_part(x.key, ':', 1), ',' ORDER BY split_part(x.key, ':', 1)) FILTER (WHERE x.country = y.country AND u.key IS NOT NULL) AS usef
        FROM truth t JOIN k2 x ON x.entity_id = t.query_id JOIN k2 y ON y.entity_id = t.true_id AND x.key = y.key LEFT JOIN dus u ON u.country = x.country AND u.key = x.key GROUP BY 1, 2) s ON s.query_id = t.query_id AND s.true_id = t.true_id""", "truth", "er", "drk"),
    "posting_sizes": query("""SELECT family, n AS count, v[1 + CAST(floor((n - 1) * 0.5) AS BIGINT)] AS p50, v[1 + CAST(floor((n - 1) * 0.9) AS BIGINT)] AS p90, v[1 + CAST(floor((n - 1) * 0.99) AS BIGINT)] AS p99, v[n] AS max
        FROM (SELECT split_part(q.key, ':', 1) AS family, count(*) AS n, list_sort(list(coalesce(df, 0))) AS v FROM k2 q LEFT JOIN dst USING (country, key) WHERE entity_id LIKE 'S1-%' GROUP BY 1)""", "k2", "dst"),
    "block_rules_by_support": query(f"""SELECT rule, {r6('avg(f05)', 'macro_f05')}, {r6('coalesce(avg(CASE WHEN true_n = 0 THEN CASE WHEN predicted_n = 0 THEN 1.0 ELSE 0.0 END END), 0)', 'singleton_accuracy')} FROM (SELECT rule, query_id, true_n, predicted_n, {F05} AS f05 FROM (
        SELECT rule, s1.query_id, (SELECT count(*) FROM truth t WHERE t.query_id = s1.query_id) AS true_n, count(c.candidate_id) AS predicted_n, count(t.true_id) AS tp
        FROM s1 CROSS JOIN (VALUES ('overlap', 1, 1000000000), ('two-supports', 2, 1000000000), ('top3', 1, 3), ('top1', 1, 1)) g(rule, least, most)
        LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY support DESC, candidate_id) AS place FROM sup8) c ON c.query_id = s1.query_id AND support >= least AND place <= most
        LEFT JOIN truth t ON t.query_id = c.query_id AND t.true_id = c.candidate_id GROUP BY rule, s1.query_id)) GROUP BY rule""", "s1", "truth", "sup8"),
    "dev_sample": query(f"""SELECT source1_entity_id, country, match_count, bucket, split, split = 'valid' AND place <= quota AND (dev_n <= 50 OR nth <= 50) AS dev_sample FROM (
        SELECT *, count(*) FILTER (WHERE split = 'valid' AND place <= quota) OVER () AS dev_n, sum(CASE WHEN split = 'valid' AND place <= quota THEN 1 ELSE 0 END) OVER (ORDER BY source1_entity_id) AS nth FROM (
        SELECT sp.*, row_number() OVER (PARTITION BY sp.country, sp.bucket, split ORDER BY md5('{SEED + 1}|' || source1_entity_id), source1_entity_id) AS place, coalesce(CASE WHEN share = 0 AND used < 50 THEN 1 ELSE share END, 0) AS quota
        FROM ({_SPLIT}) sp LEFT JOIN (SELECT country, bucket, share, coalesce(sum(greatest(least(n, share), 1)) OVER (ORDER BY country, bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM (
        SELECT country, bucket, n, round_even(n * 50 / CAST(sum(n) OVER () AS DOUBLE), 0) AS share FROM (SELECT country, bucket, count(*) AS n FROM ({_SPLIT}) WHERE split = 'valid' GROUP BY 1, 2))) q ON q.country = sp.country AND q.bucket = sp.bucket))""", "s1", "truth"),
    "quota_allocation": query(f"""{_allocation('p', 'greatest(total // 5, 1, strata)', 1)}, {_allocation('m', 'greatest(total // 5, 1)', 0).removeprefix('WITH ')}
        SELECT country, bucket, p.available, CAST(p.quota AS BIGINT) AS pilot, CAST(m.quota AS BIGINT) AS members FROM p JOIN m USING (country, bucket)"""),
}
