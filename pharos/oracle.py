"""DuckDB twins of the search operators, written from their definitions, for the registered oracles."""

from __future__ import annotations

from pharos.functions import tokenizer as Z

DOCS = ("documents", "doc_id", ("text",))
PARTS = ("part", "p_partkey", ("p_name", "p_type", "p_brand"))


def tokens(source: tuple[str, str, tuple[str, ...]], where: str = "true") -> str:
    """Subquery (doc_id, fid, pos, word) over a table's text fields."""
    name, key, fields = source
    each = " UNION ALL ".join(f"SELECT {key} AS doc_id, {i} AS fid, {Z.SQL.format(text=f)} AS ws FROM {name} WHERE {where}" for i, f in enumerate(fields))
    return f"(SELECT doc_id, fid, i - 1 AS pos, word FROM (SELECT doc_id, fid, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM ({each})) WHERE word <> '\x01' AND strlen(word) <= 250 AND i <= 65536)"


def typo(word: str, budget: int, prefix: bool) -> str:
    """Typos that column ``word`` costs for a query word, null if it isn't a derivation."""
    plain = f"word LIKE '{word}%'" if prefix else f"word = '{word}'"
    dist = f"list_min([damerau_levenshtein(left(word, k), '{word}') FOR k IN range(0, least(length(word), {len(word) + budget}) + 1)])" if prefix else f"damerau_levenshtein(word, '{word}')"
    cases = f"WHEN {plain} THEN 0"
    if budget:
        cases += f" WHEN left(word, 1) = '{word[0]}' AND {dist} <= {budget} THEN {dist}"
    if budget == 2:
        cases += f" WHEN left(word, 1) <> '{word[0]}' AND {dist} <= 1 THEN 2"
    return f"CASE {cases} END"


def search(source, units: list[tuple[str, bool, int]], forms: list[list[int]], rules: tuple[str, ...], where: str = "true", words_rule: bool = True) -> str:
    """All hits with their buckets: (key, words, ...rules). ``forms`` are the successively shorter queries."""
    key = source[1]
    n = len(units)
    ev = " UNION ALL ".join(f"SELECT doc_id, fid, pos, {i} AS unit, {typo(w, b, p)} AS typo FROM (SELECT * FROM tk WHERE {typo(w, b, p)} IS NOT NULL)" for i, (w, p, b) in enumerate(units))
    aggs = ", ".join(f"min(typo) FILTER (unit = {i}) AS t{i}, min(fid * 65536 + pos) FILTER (unit = {i}) AS p{i}" for i in range(n))
    has = lambda f: " AND ".join(f"t{i} IS NOT NULL" for i in f)
    words = "CASE " + " ".join(f"WHEN {has(f)} THEN {k}" for k, f in enumerate(forms)) + " END"
    ctes = [f"tk AS {tokens(source, where)}", f"ev AS ({ev})", f"per AS (SELECT doc_id, {aggs} FROM ev GROUP BY doc_id)"]
    pairs = sorted({p for f in forms for p in zip(f, f[1:], strict=False)}) if "proximity" in rules else []
    joins = ""
    for i, j in pairs:
        ctes.append(
            f"d{i}_{j} AS (SELECT a.doc_id, min(CASE WHEN b.pos > a.pos THEN b.pos - a.pos ELSE a.pos - b.pos + 1 END) AS d FROM ev a JOIN ev b "
            f"ON a.doc_id = b.doc_id AND a.fid = b.fid AND a.unit = {i} AND b.unit = {j} AND a.pos <> b.pos GROUP BY a.doc_id)"
        )
        joins += f" LEFT JOIN d{i}_{j} ON d{i}_{j}.doc_id = per.doc_id"

    def best(value) -> str:
        """Value of the document's own form, or the least over the forms it matches."""
        if words_rule:
            return "CASE words " + " ".join(f"WHEN {k} THEN {value(f)}" for k, f in enumerate(forms)) + " END"
        return "least(" + ", ".join(f"CASE WHEN {has(f)} THEN {value(f)} END" for f in forms) + ")"

    near = lambda i, j: f"least(7, greatest(0, coalesce(d{i}_{j}.d, 8) - 1))"
    columns = {
        "typo": lambda: best(lambda f: " + ".join(f"t{i}" for i in f)),
        "proximity": lambda: best(lambda f: " + ".join(["0", *(near(i, j) for i, j in zip(f, f[1:], strict=False))])),
        "attribute": lambda: best(lambda f: "(" + " + ".join(f"greatest(0, list_sort([{', '.join(f'p{i}' for i in f)}])[{m + 1}] - {m})" for m in range(len(f))) + f") * 2520 // {len(f)}"),
        "exactness": lambda: f"CASE WHEN ex.full_match THEN 0 WHEN ex.starts THEN 1 ELSE {2 + n} - coalesce(ex.contained, 0) END",
    }
    out = [f"CAST({columns[r]()} AS BIGINT) AS {r}" for r in rules if r in columns]
    if "exactness" in rules:
        placed = " OR ".join(f"(word = '{w}' AND pos = {i})" for i, (w, _, _) in enumerate(units))
        inside = " + ".join(f"CAST(bool_or(word = '{w}') AS INT)" for w, _, _ in units)
        ctes.append(
            f"ex AS (SELECT doc_id, bool_or(placed = {n} AND len = {n}) AS full_match, bool_or(placed = {n}) AS starts, any_value(total) AS contained FROM "
            f"(SELECT doc_id, fid, count(*) FILTER ({placed}) AS placed, max(pos) + 1 AS len FROM tk GROUP BY doc_id, fid) "
            f"JOIN (SELECT doc_id, {inside} AS total FROM tk GROUP BY doc_id) USING (doc_id) GROUP BY doc_id)"
        )
        joins += " LEFT JOIN ex ON ex.doc_id = per.doc_id"
    return f"WITH {', '.join(ctes)} SELECT per.doc_id AS {key}, CAST(words AS BIGINT) AS words{''.join(', ' + c for c in out)} FROM (SELECT *, {words} AS words FROM per) per{joins} WHERE words IS NOT NULL"
