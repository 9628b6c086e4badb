"""DuckDB SQL text for the scalar functions (oracle side only)."""

from __future__ import annotations

from ranktide.catalog.bridge_sql import AS_OF_SQL


def d(x: float) -> str:
    return f"{float(x)!r}::DOUBLE"


def popularity(dw: str, stars: str) -> str:
    return (
        f"greatest(0.0::DOUBLE, least(100.0::DOUBLE, 100.0::DOUBLE * ("
        f"0.7::DOUBLE * coalesce(log10(1.0::DOUBLE + CAST({dw} AS DOUBLE)) / log10(1.0::DOUBLE + 100000000.0::DOUBLE), 0.0::DOUBLE)"
        f" + 0.3::DOUBLE * coalesce(log10(1.0::DOUBLE + CAST({stars} AS DOUBLE)) / log10(1.0::DOUBLE + 100000.0::DOUBLE), 0.0::DOUBLE))))"
    )


def severity(cvss: str) -> str:
    return f"greatest(0.0::DOUBLE, least(100.0::DOUBLE, coalesce(CAST({cvss} AS DOUBLE), 5.0::DOUBLE) * 10.0::DOUBLE))"


def effort(fv: str, summary: str) -> str:
    s = f"lower(coalesce({summary}, ''))"
    return (
        f"(CASE WHEN {fv} IS NULL OR len({fv}) = 0 THEN 20.0::DOUBLE"
        f" WHEN contains({s}, 'breaking') OR contains({s}, 'rewrite') OR contains({s}, 'rearchitect')"
        f" OR contains({s}, 'removed api') THEN 60.0::DOUBLE"
        f" WHEN coalesce(regexp_matches({fv}[1], '^[vV]*[0-9]+([.].*)?$'), FALSE) THEN 95.0::DOUBLE"
        f" ELSE 70.0::DOUBLE END)"
    )


def age_days(ts: str, as_of: str = AS_OF_SQL) -> str:
    return f"(CAST(date_diff('microsecond', {ts}, {as_of}) AS DOUBLE) / 86400000000.0::DOUBLE)"


def confidence(pr: str, as_of: str = AS_OF_SQL) -> str:
    days = age_days(pr, as_of)
    return (
        f"(CASE WHEN {pr} IS NULL THEN 30.0::DOUBLE WHEN {days} <= 14.0::DOUBLE THEN 100.0::DOUBLE"
        f" WHEN {days} >= 365.0::DOUBLE THEN 0.0::DOUBLE"
        f" ELSE 100.0::DOUBLE * (1.0::DOUBLE - ({days} - 14.0::DOUBLE) / 351.0::DOUBLE) END)"
    )


def impact(pop: str, sev: str) -> str:
    return f"(({pop}) / 100.0::DOUBLE * ({sev}))"


def final(imp: str, eff: str, conf: str) -> str:
    return f"(0.6::DOUBLE * ({imp}) + 0.25::DOUBLE * ({eff}) + 0.15::DOUBLE * ({conf}))"


def score_macro(cvss: str, dw: str, stars: str, fv: str, summary: str, pr: str, as_of: str = AS_OF_SQL) -> str:
    return f"({final(impact(popularity(dw, stars), severity(cvss)), effort(fv, summary), confidence(pr, as_of))} / 100.0::DOUBLE)"


def band_score(band: str) -> str:
    return (
        f"(CASE {band} WHEN 'drop-in' THEN 95.0::DOUBLE WHEN 'minor-migration' THEN 70.0::DOUBLE"
        f" WHEN 'codemod-available' THEN 60.0::DOUBLE WHEN 'rewrite' THEN 20.0::DOUBLE ELSE 50.0::DOUBLE END)"
    )


def is_native(to_purls: str) -> str:
    return f"coalesce(len(list_filter({to_purls}, lambda p: contains(p, '<native>'))) > 0, FALSE)"


def repl_severity(axis: str, native: str) -> str:
    return f"(CASE WHEN {native} THEN 75.0::DOUBLE WHEN {axis} = 'perf' THEN 60.0::DOUBLE ELSE 45.0::DOUBLE END)"


def r6(x: str) -> str:
    return f"round({x}, 6)"


# ---- semver ---------------------------------------------------------------------------

def strip_ws(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def parse_version(v: str) -> str:
    core = f"split_part(split_part({strip_ws(f'ltrim({v}, {chr(39)}v{chr(39)})')}, '-', 1), '+', 1)"
    parts = f"string_split({core}, '.')"
    ok = f"list_bool_and(list_transform({parts}, lambda q: regexp_matches(q, '^\\s*[0-9]+\\s*$')))"
    return f"(CASE WHEN {core} <> '' AND {ok} THEN list_transform({parts}, lambda q: CAST({strip_ws('q')} AS DECIMAL(38,0))) END)"


def version_cmp(a: str, b: str) -> str:
    n = f"greatest(len({a}), len({b}))"
    pa = f"list_resize({a}, {n}, CAST(0 AS DECIMAL(38,0)))"
    pb = f"list_resize({b}, {n}, CAST(0 AS DECIMAL(38,0)))"
    return f"(CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL WHEN {pa} < {pb} THEN -1 WHEN {pa} > {pb} THEN 1 ELSE 0 END)"


_OPS = ("<=", ">=", "<", ">", "=")
_SAT = {"<": "< 0", "<=": "<= 0", ">": "> 0", ">=": ">= 0", "=": "= 0"}


def _clause_code(c: str, target: str) -> str:
    whens = []
    for op in _OPS:
        bound = parse_version(strip_ws(f"substr({c}, {len(op) + 1})"))
        cmp_ = version_cmp(target, bound)
        whens.append(
            f"WHEN starts_with({c}, '{op}') THEN (CASE WHEN {bound} IS NULL THEN -1 WHEN {cmp_} {_SAT[op]} THEN 1 ELSE 0 END)"
        )
    return "(CASE " + " ".join(whens) + " ELSE -1 END)"


def version_in_range(version: str, rng: str) -> str:
    target = parse_version(version)
    clauses = f"list_filter(list_transform(string_split({rng}, ','), lambda c: {strip_ws('c')}), lambda c: c <> '')"
    codes = f"list_transform({clauses}, lambda c: {_clause_code('c', target)})"
    first_bad = f"list_filter({codes}, lambda x: x <> 1)[1]"
    return (
        f"(CASE WHEN {target} IS NULL OR {rng} IS NULL THEN NULL WHEN {first_bad} IS NULL THEN TRUE"
        f" WHEN {first_bad} = 0 THEN FALSE ELSE NULL END)"
    )


def render_version(parts: str) -> str:
    return f"array_to_string(list_transform({parts}, lambda q: CAST(q AS VARCHAR)), '.')"


def purl_name(p: str) -> str:
    q = f"(CASE WHEN starts_with({p}, 'pkg:npm/') THEN substr({p}, 9) ELSE {p} END)"
    return f"(CASE WHEN starts_with({q}, 'pkg:github/') THEN substr({q}, 12) ELSE {q} END)"


def uuid5(name: str) -> str:
    h = f"sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({name}))"
    variant = f"lower(printf('%x', (CAST(('0x' || substr({h}, 17, 1)) AS INTEGER) & 3) | 8))"
    return (
        f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || {variant}"
        f" || substr({h}, 18, 3) || '-' || substr({h}, 21, 12))"
    )


def round_one_place(x: str) -> str:
    """To one decimal place by the double's exact value, ties to even: 10 x as 8 x + 2 x and that sum's rounding error."""
    s, back = f"(abs({x}) * 8 + abs({x}) * 2)", f"((abs({x}) * 8 + abs({x}) * 2) - abs({x}) * 8)"
    e = f"((abs({x}) * 8 - ({s} - {back})) + (abs({x}) * 2 - {back}))"
    part = f"({s} - floor({s}))"
    up = f"CASE WHEN {part} > 0.5::DOUBLE OR ({part} = 0.5::DOUBLE AND ({e} > 0 OR ({e} = 0 AND floor({s}) % 2 = 1))) THEN 1 ELSE 0 END"
    return f"(sign({x}) * (floor({s}) + {up}) / 10.0::DOUBLE)"
