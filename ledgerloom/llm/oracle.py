"""The corpus queries that SQL can express, for another engine."""

from __future__ import annotations

from ledgerloom.llm import licenses, quality, urls
from ledgerloom.llm.common import LOWER, UPPER

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_DEALT = "coalesce(text, '')"


def _quality() -> str:
    def part(name: str) -> str:
        top, bottom, *_ = quality.SHARES[name]
        return f"CASE WHEN {bottom} = 0 THEN 0 ELSE ({top} * {quality.UNIT}) // {bottom} END"

    parts = " UNION ALL ".join(f"SELECT lang, source, '{s}' AS share, {part(s)} AS v FROM passed" for s in quality.SHARES)
    per_share = lambda k: "CASE share " + " ".join(f"WHEN '{s}' THEN {rule[k]}" for s, rule in quality.SHARES.items()) + " END"
    q = f"quantile_rows AS (SELECT *, greatest(length(bin(v)) - 6, 0) AS d FROM ({parts}))"

    def level(name: str, keys: str) -> str:
        group = f"{keys}, " if keys else ""
        return f"""{name} AS (SELECT {group}share, max(total) AS docs, min(b) FILTER (100 * c >= (100 - tail) * total) AS below,
            min(b) FILTER (100 * c >= 50 * total) AS middle, min(b) FILTER (100 * c >= tail * total) AS above
          FROM (SELECT {group}share, {per_share(2)} AS tail, b, sum(n) OVER (PARTITION BY {group}share ORDER BY b) AS c, sum(n) OVER (PARTITION BY {group}share) AS total
            FROM (SELECT {group}share, (v >> d) << d AS b, count(*) AS n FROM quantile_rows GROUP BY ALL)) GROUP BY ALL)"""

    pick = lambda c: f"CASE WHEN o.docs >= {quality.MIN_DOCS} THEN o.{c} WHEN l.docs >= {quality.MIN_DOCS} THEN l.{c} ELSE e.{c} END AS {c}"
    fits = " AND ".join(
        f"coalesce({part(s)} <= (SELECT high FROM limits t WHERE t.lang IS NOT DISTINCT FROM c.lang AND t.source IS NOT DISTINCT FROM c.source AND t.share = '{s}'), true)"
        for s in quality.SHARES
    )
    low = f"coalesce({part('length')} >= (SELECT low FROM limits t WHERE t.lang IS NOT DISTINCT FROM c.lang AND t.source IS NOT DISTINCT FROM c.source AND t.share = 'length'), true)"
    return rf"""WITH base AS (SELECT doc_id, lang, source, text AS t, {_WORDS} AS w,
        list_filter(string_split({_DEALT}, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
      tri AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM base)),
      twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM tri) WHERE n > 1),
      marked AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
      counts AS (SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        length(regexp_replace(coalesce(t, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(m.n, 0)::BIGINT AS n_repeat_words,
        length(regexp_replace(coalesce(t, ''), '[^A-Z]', '', 'g'))::BIGINT AS n_upper, len(lines)::BIGINT AS n_lines
        FROM base LEFT JOIN marked m USING (doc_id)),
      flagged AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM counts),
      passed AS (SELECT * FROM flagged WHERE NOT base_failed), {q}, {level("own", "lang, source")}, {level("by_lang", "lang")}, {level("by_all", "")},
      limits AS (SELECT lang, source, share, above + reach * (above - middle) + least_floor AS high, below - reach * (middle - below) - least_floor AS low
        FROM (SELECT *, {per_share(3)} AS reach, {per_share(4)} AS least_floor FROM (SELECT o.lang, o.source, o.share, {pick("below")}, {pick("middle")}, {pick("above")}
          FROM own o JOIN by_lang l ON o.lang IS NOT DISTINCT FROM l.lang AND o.share = l.share JOIN by_all e ON o.share = e.share)))
      SELECT doc_id, {", ".join(quality.COUNTS)}, base_failed, NOT base_failed AND {fits} AND {low} AS kept FROM flagged c"""


def _licenses() -> str:
    known = licenses.known_sentences()
    rows = ", ".join(f"('{k}', '{v}')" for k, v in known.items())
    # RE2 has no look-ahead: a dot that ends a word is followed by something that stays.
    broken = r"regexp_replace(regexp_replace(coalesce(text, ''), '[!?;:\n\r]+', chr(10), 'g'), '[.]+([^A-Za-z0-9.]|$)', chr(10) || '\1', 'g')"
    steps = ""
    names = []
    for k, (name, seq) in enumerate(licenses.RULES):
        pattern = "".join(map(licenses.token, seq))
        steps += f", s{k + 1} AS (SELECT * REPLACE (replace(seq, '{pattern}', '<>') AS seq, CASE WHEN contains(seq, '{pattern}') THEN list_append(names, '{name}') ELSE names END AS names) FROM s{k})"
        names.append(name)
    order = "[" + ", ".join(f"'{n}'" for n in dict.fromkeys(names)) + "]"
    return rf"""WITH known(sentence, token) AS (VALUES {rows}),
      parts AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(translate({broken}, '{UPPER}', '{LOWER}'), '[^a-z0-9.\n]+', ' ', 'g'), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS p FROM documents),
      hits AS (SELECT doc_id, string_agg(token, '' ORDER BY i) AS seq, count(*) AS n
        FROM (SELECT doc_id, unnest(p) AS sentence, unnest(range(len(p))) AS i FROM parts) JOIN known USING (sentence) GROUP BY doc_id),
      s0 AS (SELECT d.doc_id, len(d.p)::BIGINT AS n_sentences, coalesce(h.n, 0)::BIGINT AS n_known, coalesce(h.seq, '') AS seq, coalesce(h.seq, '') AS sequence, []::VARCHAR[] AS names
        FROM parts d LEFT JOIN hits h USING (doc_id)){steps}
      SELECT doc_id, n_sentences, n_known, sequence, array_to_string(list_filter({order}, lambda x: list_contains(names, x)), ',') AS licenses FROM s{len(names)}"""


def _urls() -> str:
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in urls.RULES)
    return rf"""WITH rules(verdict, rhost, rpath) AS (VALUES {rules}),
      rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN url[instr(url, '://') + 3:] ELSE '' END AS r FROM pages),
      placed AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
        regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM (SELECT page_id, coalesce(r, '') AS r FROM rest)),
      places AS (SELECT DISTINCT host, path FROM placed),
      judged AS (SELECT host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
        FROM places JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL)
      SELECT page_id, host, path, rule, coalesce(verdict, '{urls.DEFAULT}') AS verdict FROM placed LEFT JOIN judged USING (host, path)"""


#: Levels the SQL of the Merkle trees goes up: enough for 8 ** 8 leaves a language and 8 ** 3 languages.
_LEVELS, _TOP_LEVELS = 8, 3


def _tree(name: str, levels: int) -> str:
    """Nodes of each level above ``<name>0`` (tree, idx, d, cnt), the runs of siblings, and the roots."""
    out = ""
    for k in range(levels):
        out += f"""{name}{k + 1} AS (SELECT tree, idx // 8 AS idx, sha256(string_agg(d, '' ORDER BY idx)) AS d, max((cnt + 7) // 8) AS cnt FROM {name}{k} WHERE cnt > 1 GROUP BY tree, idx // 8),
      {name}_runs{k} AS (SELECT tree, idx // 8 AS parent, list(d ORDER BY idx) AS ds FROM {name}{k} WHERE cnt > 1 GROUP BY tree, idx // 8),
      """
    roots = " UNION ALL ".join(f"SELECT tree, d FROM {name}{k} WHERE cnt = 1" for k in range(levels + 1))
    return f"{out}{name}_roots AS ({roots})"


def _fold(name: str, tree: str, levels: int) -> str:
    """Steps ``<name>1`` and on from ``<name>0``, which has tree, idx, the folded digest f and the text of the siblings p."""
    out = []
    for k in range(levels):
        slot = f"(s.idx // {8**k}) % 8 + 1"
        out.append(f"""{name}{k + 1} AS (SELECT s.* REPLACE (
        CASE WHEN r.ds IS NULL THEN f ELSE sha256(array_to_string(list_transform(r.ds, lambda x, i: CASE WHEN i = {slot} THEN f ELSE x END), '')) END AS f,
        p || coalesce(array_to_string(list_filter(r.ds, lambda x, i: i <> {slot}), ''), '') AS p)
        FROM {name}{k} s LEFT JOIN {tree}_runs{k} r ON s.tree IS NOT DISTINCT FROM r.tree AND s.idx // {8 ** (k + 1)} = r.parent)""")
    return ", ".join(out)


def _merkle() -> str:
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
    head = " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars"))
    bits = "lambda c, d: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END"
    step = f"lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), {bits})"
    chars = "list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)"
    check = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {chars}), {step}), 4294967295::BIGINT)"
    return rf"""WITH hashed AS (SELECT doc_id, lang AS tree, sha256({head} || {part("text")}) AS leaf,
        CASE WHEN {check} % 3 = 0 THEN sha256({head} || {part(f"translate(text, '{UPPER}', '{LOWER}')")}) ELSE sha256({head} || {part("text")}) END AS f FROM documents),
      base AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS LAST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS cnt FROM hashed),
      n0 AS (SELECT tree, idx, leaf AS d, cnt FROM base), {_tree("n", _LEVELS)},
      placed AS (SELECT tree AS lang, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS idx, d, count(*) OVER () AS cnt FROM n_roots),
      t0 AS (SELECT 0 AS tree, idx, d, cnt FROM placed), {_tree("t", _TOP_LEVELS)},
      s0 AS (SELECT doc_id, leaf, tree, idx, f, '' AS p FROM base), {_fold("s", "n", _LEVELS)},
      u0 AS (SELECT s.doc_id, s.leaf, s.f, s.p, 0 AS tree, x.idx, x.d AS subroot FROM s{_LEVELS} s JOIN placed x ON s.tree IS NOT DISTINCT FROM x.lang), {_fold("u", "t", _TOP_LEVELS)}
      SELECT doc_id, leaf, subroot, r.d AS root, sha256(p) AS proof_sha256, f AS folded_root, f = r.d AS verified FROM u{_TOP_LEVELS} u CROSS JOIN t_roots r"""


def _negatives() -> str:
    dot = "list_reduce(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]), lambda x, y: x + y)"
    return rf"""WITH usable AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
      scored AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, {dot} AS score
        FROM usable a JOIN usable b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
      positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
      SELECT p.anchor_id, positive_id, (row_number() OVER w)::INT AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
      FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
      WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 10"""


SQL = {"op3_quality_rules": _quality(), "op5_license_scan": _licenses(), "op8_url_filter": _urls(), "op11_hard_negatives": _negatives(), "op13_merkle_manifest": _merkle()}
