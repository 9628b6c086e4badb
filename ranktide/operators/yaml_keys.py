"""The keys of YAML mappings, block or flow, with their paths: a pushdown scan as one fold over a text's lines.

The state is the stack of open block keys with their indents, the stack of open
flow collections, and what a line may leave open: a key without a value yet, a
block scalar, a quoted scalar. A block line pops what is indented as deep or
deeper and pushes its key; a value that opens ``{`` or ``[``, and every line until
it is closed, is cut into tokens that are folded over the flow stack.

Read: mappings and sequences in both styles and mixed, any indents, all three
kinds of scalars and quotes, block scalars, comments, ``? key``, anchors and tags
(passed over). Not read: aliases and merge keys (not expanded), escapes in double
quotes other than of single characters, flow scalars over several lines. A text
that breaks the rules (indents that fit no open mapping, brackets that don't match,
a second document, tabs as indents, values that hold ``: ``) gives nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ranktide.functions.util import let
from ranktide.operators.folds import fold_lines

# YAML's rules for what a scalar is and where it ends.
DOUBLE = r'"(?:[^"\\]|\\.)*"'
SINGLE = r"'(?:[^']|'')*'"
PLAIN_KEY = r"(?:(?![ \t]#|:(?:[ \t]|$)).)+"
KEY = rf"^({DOUBLE}|{SINGLE}|[^\s\[\]{{}},#&*!|>%@`\"']{PLAIN_KEY}|[^\s\[\]{{}},#&*!|>%@`\"':-]|[&!][^ \t]*[ \t]+{PLAIN_KEY})[ \t]*:(?:[ \t]+(.*))?$"
FLOW_PLAIN = r"""[^ \t,\[\]{}"'#](?:[^,\[\]{}:#]|:(?![ \t,\[\]{}]|$)|(?<![ \t])#)*"""
FLOW_TOKEN = rf"""{DOUBLE}|{SINGLE}|["']|[{{}}\[\],]|(?<=["']):|:(?=[ \t,\[\]{{}}]|$)|(?:^|(?<=[ \t]))#.*|{FLOW_PLAIN}"""
# End of fixed values.

_STATE = {
    "path": "array<struct<indent:int,key:string>>", "flow": "array<struct<kind:string,key:string>>", "pending": "string",
    "skip": "int", "quote": "string", "open": "boolean", "bad": "boolean",
}


def _scalar(raw: Column) -> Column:
    """A scalar's value; quotes and simple escapes removed."""
    inner = F.substring(raw, F.lit(2), F.length(raw) - 2)
    return (
        F.when(raw.startswith("'"), F.replace(inner, F.lit("''"), F.lit("'")))
        .when(raw.startswith('"'), F.regexp_replace(inner, r"\\(.)", "$1"))
        .otherwise(F.regexp_replace(F.rtrim(raw), r"^[&!][^ \t]*[ \t]+", ""))
    )


def yaml_keys(
    text: Column, found: str, pick: Callable[[Column, Column], Column],
    chunk: int = 256,
) -> Column:
    """What ``pick(keys, line number)`` makes of each mapping key, as ``array<found>`` without nulls; empty for broken texts.

    ``keys`` are the keys from the document's root to this one; what lies in a
    sequence has a null among them.
    """
    empty_path = F.array().cast(_STATE["path"])
    empty_flow = F.array().cast(_STATE["flow"])
    nothing = F.array().cast(f"array<{found}>")

    def state(old: Column, found_: Column, **new: Column) -> Column:
        return F.struct(*[new.get(k, old[k]).cast(t).alias(k) for k, t in _STATE.items()], found_.alias("found"))

    def picked(keys: Column, number: Column) -> Column:
        return F.filter(F.array(pick(keys, number)), lambda x: x.isNotNull())

    def flow_token(s: Column, token: Column, number: Column) -> Column:
        """The state after one token of a flow collection."""
        top = F.get(s["flow"], F.size(s["flow"]) - 1)
        below = F.slice(s["flow"], F.lit(1), F.greatest(F.size(s["flow"]) - 1, F.lit(0)))
        entry = lambda kind, key: F.array(F.struct(kind.alias("kind"), key.cast("string").alias("key")))

        def known(t: Column) -> Column:
            def after(new: Column) -> Column:
                keys = F.concat(F.transform(s["path"], lambda e: e["key"]), F.transform(new["keyed"], lambda e: e["key"]))
                wrong = (
                    F.when(t["begins"], ~(t["opens"] & s["open"]))
                    .when(t["opens"], t["keyless"])  # a collection is no key here
                    .when(t["ends"], top["kind"] != F.when(token == "}", "m").otherwise("s"))
                    .when(token == ":", (top["kind"] == "m") & ~t["alone"])
                    .when(token.isin('"', "'"), True)
                    .otherwise((token != ",") & t["keyless"] & s["pending"].isNotNull())
                )
                flow = (
                    F.when(t["opens"], F.concat(s["flow"], entry(F.when(token == "{", "m").otherwise("s"), F.lit(None))))
                    .when(t["ends"], below)
                    .when((token == ",") & (top["kind"] == "m"), F.concat(below, entry(F.lit("m"), F.lit(None))))
                    .when((token == ":") & t["alone"], new["keyed"]).otherwise(s["flow"])
                )
                told = t["alone"] & (t["ends"] | token.isin(",", ":"))
                return state(
                    s, F.when(told, F.concat(s["found"], picked(keys, number))).otherwise(s["found"]), flow=flow,
                    pending=F.when(t["keyless"] & ~t["marks"], _scalar(token)).when(~t["marks"], s["pending"]),
                    open=s["open"] & ~t["ends"], bad=s["bad"] | F.coalesce(wrong, F.lit(False)),
                )

            return let(F.struct(F.concat(below, entry(F.lit("m"), s["pending"])).alias("keyed")), after)

        def named(x: Column) -> Column:
            return let(F.struct(
                (F.size(s["flow"]) == 0).alias("begins"), x["keyless"].alias("keyless"), (x["keyless"] & s["pending"].isNotNull()).alias("alone"),
                token.isin("{", "[").alias("opens"), token.isin("}", "]").alias("ends"),
                token.isin("{", "[", "}", "]", ",", ":").alias("marks"),
            ), known)

        keyless = F.coalesce((top["kind"] == "m") & top["key"].isNull(), F.lit(False))
        return F.when(token.startswith("#"), s).otherwise(let(F.struct(keyless.alias("keyless")), named))

    #: What a line is made out to be, before its value: the new path and whether its last key is new, the value (null: none)
    #: and the column that it belongs to, and the text that belongs to a flow collection (null: none).
    line_fields = {
        "path": _STATE["path"], "new": "boolean", "value": "string", "col": "int", "flow": "string", "skip": "int", "quote": "string",
        "open": "boolean", "bad": "boolean",
    }

    def made_out(**fields: Column) -> Column:
        return F.struct(*[fields[k].cast(t).alias(k) for k, t in line_fields.items()])

    def in_between(s: Column, line: Column, kind: Column) -> Column:
        """A line that isn't block content: blank, a comment, or inside a scalar or a flow collection."""
        ends = F.when(s["quote"] == "'", line.rlike(r"^(?:[^']|'')*'[ \t]*(?:#.*)?$")).otherwise(line.rlike(r'^(?:[^"\\]|\\.)*"[ \t]*(?:#.*)?$'))
        return made_out(
            path=s["path"], new=F.lit(False), value=F.lit(None), col=F.lit(0), flow=F.when(kind == "flow", line),
            skip=F.when(kind == "mark", -1).otherwise(s["skip"]), quote=F.when((kind == "quote") & ends, "").otherwise(s["quote"]),
            open=s["open"], bad=s["bad"] | (kind == "tab") | ((kind == "mark") & line.startswith("---") & (F.size(s["path"]) > 0)),
        )

    def block_line(s: Column, line: Column, indent: Column) -> Column:
        body = F.substring(line, indent + 1, F.length(line))
        dashes = F.regexp_extract(body, r"^((?:-[ \t]+)*(?:-$)?)", 1)

        def after_dashes(d: Column) -> Column:
            rest = F.substring(body, F.length(d["dashes"]) + 1, F.length(body))
            explicit = rest.rlike(r"^\?[ \t]")
            above = F.filter(s["path"], lambda e: (e["indent"] < indent) | ((e["indent"] == indent) & e["key"].isNotNull()))
            # An item stands under its key, at the key's own indent or deeper; what it holds has a null on its path.
            marked = F.concat(above, F.array(F.struct(indent.cast("int").alias("indent"), F.lit(None).cast("string").alias("key"))))
            seq = F.length(d["dashes"]) > 0
            return let(F.struct(
                seq.alias("seq"), (indent + F.length(d["dashes"])).cast("int").alias("col"), rest.alias("rest"), explicit.alias("explicit"),
                (explicit | rest.rlike(KEY)).alias("keyed"), F.when(seq, marked).otherwise(s["path"]).alias("path"),
            ), after_rest)

        def after_rest(x: Column) -> Column:
            raw = F.when(x["explicit"], F.regexp_replace(x["rest"], r"^\?[ \t]+", "")).otherwise(F.regexp_extract(x["rest"], KEY, 1))
            key = F.array(F.struct(x["col"].alias("indent"), _scalar(raw).alias("key")))
            kept = F.filter(x["path"], lambda e: e["indent"] < x["col"])
            last = F.get(x["path"], F.size(x["path"]) - 1)
            answer = x["rest"].rlike(r"^:(?:[ \t]|$)")  # the value of an explicit key
            sibling = F.exists(x["path"], lambda e: (e["indent"] == x["col"]) & e["key"].isNotNull())
            child = ~F.exists(x["path"], lambda e: e["indent"] >= x["col"]) & s["open"]
            fits = (F.size(x["path"]) == 0) | x["seq"] | sibling | child
            hangs = (F.size(x["path"]) > 0) & ~x["seq"] & (indent <= last["indent"]) & ~s["open"]
            flows = x["rest"].rlike(r"^[\[{]")
            value = (
                F.when(x["explicit"], "").when(x["keyed"], F.trim(F.regexp_extract(x["rest"], KEY, 2)))
                .when(answer, F.trim(F.substring(x["rest"], F.lit(2), F.length(x["rest"])))).when(x["seq"] | flows, x["rest"])
            )
            wrong = F.when(x["keyed"], ~fits).when(answer | x["seq"] | flows, False).otherwise(hangs | x["rest"].rlike(r"^[\]}@`\t]"))
            return made_out(
                path=F.when(x["keyed"], F.concat(kept, key)).otherwise(x["path"]), new=x["keyed"], value=value,
                col=F.when(x["keyed"], x["col"]).otherwise(indent), flow=F.lit(None), skip=F.lit(-1), quote=F.lit(""), open=s["open"],
                bad=s["bad"] | F.coalesce(wrong, F.lit(False)),
            )

        return let(F.struct(dashes.alias("dashes")), after_dashes)

    def after_value(m: Column) -> Column:
        """What a line is, after the value on it."""
        v = m["value"]
        whole = rf"^(?:{DOUBLE}|{SINGLE})"
        kind = (
            F.when(v.isNull(), "none").when(v.rlike(r"^(?:$|#)") | v.rlike(r"^[&!][^ \t]*[ \t]*(?:#.*)?$"), "later").when(v.rlike(r"^[\[{]"), "flow")
            .when(v.rlike(r"^[|>][-+0-9]*[ \t]*(?:#.*)?$"), "block").when(v.rlike(r"^[\"']"), F.when(v.rlike(whole + r"[ \t]*(?:#.*)?$"), "plain")
            .when(v.rlike(whole), "wrong").otherwise("quote"))
            .when(v.rlike(r"^[\]},@`%]") | F.regexp_replace(v, r"[ \t]#.*$", "").rlike(r":(?:[ \t]|$)"), "wrong").otherwise("plain")
        )
        return let(F.struct(kind.alias("kind")), lambda k: made_out(
            path=m["path"], new=m["new"], value=F.lit(None), col=m["col"], flow=F.when(k["kind"] == "flow", v).otherwise(m["flow"]),
            skip=F.when(k["kind"] == "block", m["col"]).otherwise(m["skip"]),
            quote=F.when(k["kind"] == "quote", F.substring(v, 1, 1)).otherwise(m["quote"]),
            open=F.when(k["kind"] == "none", m["open"]).otherwise(k["kind"].isin("later", "flow")), bad=m["bad"] | (k["kind"] == "wrong"),
        ))

    def step(s: Column, raw: Column, number: Column) -> Column:
        def classified(x: Column) -> Column:
            line, indent = x["line"], x["indent"]
            kind = (
                F.when(s["bad"] | (line == "") & (s["quote"] == ""), "blank").when(s["quote"] != "", "quote").when(F.size(s["flow"]) > 0, "flow")
                .when((s["skip"] >= 0) & (indent > s["skip"]), "blank").when(line.rlike(r"^\s*#|^%|^\.\.\.|^---(?:[ \t]|$)"), "mark")
                .when(line.rlike(r"^ *\t"), "tab").otherwise("block")
            )
            return let(F.struct(kind.alias("kind")), lambda k: let(
                F.when(k["kind"] == "block", block_line(s, line, indent)).otherwise(in_between(s, line, k["kind"])),
                lambda m: let(after_value(m), finished),
            ))

        def finished(m: Column) -> Column:
            keys = F.transform(m["path"], lambda e: e["key"])
            here = state(
                s, F.when(m["new"], picked(keys, number)).otherwise(nothing), path=m["path"], skip=m["skip"], quote=m["quote"],
                open=m["open"], bad=m["bad"],
            )
            tokens = F.regexp_extract_all(m["flow"], F.lit(f"({FLOW_TOKEN})"), 1)
            return let(here, lambda h: F.when(m["flow"].isNull(), h).otherwise(
                F.aggregate(tokens, h, lambda acc, token: flow_token(acc, token, number))
            ))

        line = F.regexp_replace(raw, r"\s+$", "")
        return let(F.struct(line.alias("line"), F.length(F.regexp_extract(raw, r"^( *)", 1)).alias("indent")), classified)

    def finish(s: Column) -> Column:
        return F.when(s["bad"] | (F.size(s["flow"]) > 0) | (s["quote"] != ""), nothing).otherwise(s["found"])

    start = {
        "path": empty_path, "flow": empty_flow, "pending": F.lit(None).cast("string"), "skip": F.lit(-1), "quote": F.lit(""),
        "open": F.lit(True), "bad": F.lit(False),
    }
    # Without a colon there is no mapping, so most other texts need no fold.
    return F.when(text.contains(":"), fold_lines(text, start, found, step, finish, chunk)).when(text.isNotNull(), nothing)
