"""Carrying a stale query over to a changed schema: by rewriting its text, or by views under the old names."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from .keys import Facts
from .sqltext import Token, outline, parses, splice, tokens

COMPLEX = ("TABLE_SPLIT", "TABLE_MERGE", "COLUMN_MERGE")
Rewriter = Callable[[str, list[dict], str], str]
#: Tables' columns, each with its type, as DataFrame.dtypes has them.
Columns = dict[str, list[tuple[str, str]]]


def quoted(name: str) -> str:
    return name if re.fullmatch(r"[^\W\d]\w*", name) else "`" + name.replace("`", "``") + "`"


def rewrite(sql: str, events: list[dict], pre: Columns | None = None) -> str:
    """Renames tables and columns, all at once, so that chains and swaps come out right.

    A column is renamed where its qualifier is the table or stands for it; without a qualifier, where the table is among
    the relations of its query or of one around it, the innermost that has such a column if pre tells. A table used as qualifier is
    renamed with it. Names that WITH defines are no tables. What a nested query shows under a renamed column's name keeps
    that name if it is asked for outside.
    """
    tables = {e["from"].lower(): e["to"] for e in events if e["op"] == "TABLE_RENAME"}
    columns = {(e["table"].lower(), e["from"].lower()): e["to"] for e in events if e["op"] == "COLUMN_RENAME"}
    known = {t.lower(): {c.lower() for c, _ in cs} for t, cs in (pre or {}).items()}
    held = outline(sql)
    now = lambda t: "" if t.lower() in held.defined else tables.get(t.lower(), t).lower()
    is_table = lambda t: t.lower() in tables and t.lower() not in held.defined
    edits = [(t.start, t.end, quoted(tables[t.word.lower()])) for t in held.relations if is_table(t.word)]
    renamed: dict[int, str] = {}
    for qualifier, column, scope in held.columns:
        if qualifier is not None:
            owner = scope.owner(qualifier.word)
            owners = [owner if owner is not None else qualifier.word]
            if is_table(qualifier.word) and owner is not None and owner.lower() == qualifier.word.lower():
                edits.append((qualifier.start, qualifier.end, quoted(tables[qualifier.word.lower()])))
        else:
            owners, at = [], scope
            while at:
                owners += at.relations.values()
                if any(column.word.lower() in known.get(t.lower(), ()) for t in at.relations.values() if t.lower() not in held.defined):
                    break
                at = at.outer
        for owner in owners:
            if owner and (to := columns.get((now(owner), column.word.lower()))):
                edits.append((column.start, column.end, quoted(to)))
                renamed[id(column)] = column.text
                break
    asked = {c.word.lower() for _, c, _ in held.columns if id(c) not in renamed}
    for scope in held.scopes:
        if held.nested(scope):
            for shown in held.projections(scope):
                if len(shown) in (1, 3) and (name := renamed.get(id(shown[-1]))) and shown[-1].word.lower() in asked:
                    edits.append((shown[-1].end, shown[-1].end, f" AS {name}"))
    return splice(sql, edits)


def relink(
    spark: SparkSession, sql: str, events: list[dict], schema_text: str | None = None, fallback: Rewriter | None = None,
    pre: Columns | None = None, post: Columns | None = None, facts: Facts | None = None,
) -> dict:
    """The rewritten query, the method (noop, ast, views, llm or parse_error) and the renames applied.

    Splits and merges go to the fallback, if there is one and the schema's text is given. With the columns of the tables before and after,
    a rewritten text is taken only if Spark makes the same plan of it as of the old one (same_plan); else, and for splits and merges
    without a fallback, the text stays and gets the old tables' definitions in front (with_old_tables). facts tells which of
    a split's parts may be left out (keys.facts).
    """
    if not events:
        return {"sql": sql, "method": "noop", "applied": []}
    ask = fallback is not None and schema_text is not None
    if not parses(spark, sql):
        return {"sql": fallback(sql, events, schema_text), "method": "llm", "applied": events} if ask else {"sql": sql, "method": "parse_error", "applied": []}
    applied = [e for kind in ("TABLE_RENAME", "COLUMN_RENAME") for e in events if e["op"] == kind]
    out = rewrite(sql, events, pre)
    if ask and any(e["op"] in COMPLEX for e in events):
        return {"sql": fallback(out, events, schema_text), "method": "llm", "applied": applied}
    if pre is not None and post is not None and same_plan(spark, sql, out, events, pre, post) is False:
        carried = with_old_tables(sql, events, pre, post, facts)
        if carried is not None:
            return {"sql": carried, "method": "views", "applied": events}
    return {"sql": out, "method": "ast", "applied": applied}


def same_plan(spark: SparkSession, old: str, new: str, events: list[dict], pre: Columns, post: Columns) -> bool | None:
    """Whether Spark resolves the new text on the new tables to the plan of the old text on the old ones; None if it doesn't resolve the old.

    Every table stands in for as many rows of nulls as its number, so that equal plans read the same columns of the same tables. Only
    columns that either text names take part, unless it has a star. Names of WITH are made views first, as plans number them.
    """
    moved = {e["from"]: e["to"] for e in events if e["op"] == "TABLE_RENAME"}
    renamed = {(e["table"], e["from"].lower()): e["to"] for e in events if e["op"] == "COLUMN_RENAME"}
    held = [outline(x) for x in (old, new)]
    read = {t.word.lower() for h in held for t in h.relations}
    words = None if any(h.whole() for h in held) else {t.word.lower() for h in held for t in h.tokens if t.kind == "name"}
    sides: tuple[dict[str, tuple[int, list]], ...] = ({}, {})
    for number, table in enumerate(sorted(t for t in pre if moved.get(t, t) not in post), len(post) + 1):
        sides[0][table] = (number, pre[table])  # it is gone
    for number, (table, columns) in enumerate(sorted(post.items()), 1):
        before = next((t for t in pre if moved.get(t, t) == table), None)
        back = {renamed.get((table, c.lower()), c).lower(): c for c, _ in pre.get(before, [])} if before else {}
        for side, name, shown in ((0, before, pre.get(before, [])), (1, table, columns)):
            if name is None or name.lower() not in read:
                continue
            used = [(c, k) for c, k in shown if words is None or _named(c, words, back, renamed, table)]
            sides[side][name] = (number, used or shown[:1])
    try:
        first = _resolved(spark, old, sides[0])
    except AnalysisException:
        return None
    try:
        return first.sameSemantics(_resolved(spark, new, sides[1]))
    except AnalysisException:
        return False


def _named(column: str, words: set[str], back: dict[str, str], renamed: dict[tuple[str, str], str], table: str) -> bool:
    """Whether a column is named, under its name before or after."""
    return any(x is not None and x.lower() in words for x in (column, back.get(column.lower()), renamed.get((table, column.lower()))))


_SETTINGS = ("spark.sql.caseSensitive", "spark.sql.ansi.enabled", "spark.sql.ansi.doubleQuotedIdentifiers")


def _resolved(spark: SparkSession, sql: str, tables: dict[str, tuple[int, list]]) -> DataFrame:
    """The query over stand-ins of the tables, in a session whose views are its own."""
    own = spark.newSession()
    for key in _SETTINGS:
        own.conf.set(key, spark.conf.get(key))
    for name, (rows, columns) in tables.items():
        row = f"({', '.join(f'CAST(NULL AS {kind})' for _, kind in columns)})"
        own.sql(f"SELECT * FROM VALUES {', '.join([row] * rows)} AS t({', '.join(quoted(c) for c, _ in columns)})").createOrReplaceTempView(quoted(name))
    definitions, main = with_list(sql)
    for name, columns, body in definitions:
        frame = own.sql(body)
        (frame.toDF(*columns) if columns else frame).createOrReplaceTempView(quoted(name))
    return own.sql(main)


def with_list(sql: str) -> tuple[list[tuple[str, list[str], str]], str]:
    """What the WITH at the beginning of a query defines (name, columns if it names them, text), and the rest of the query. A recursive
    one is left as it is."""
    toks = tokens(sql)
    if not toks or not toks[0].is_("WITH") or len(toks) > 1 and toks[1].is_("RECURSIVE"):
        return [], sql
    out, i = [], 1
    while True:
        name, columns, i = toks[i].word, [], i + 1
        if toks[i].text == "(":
            close = _closing(toks, i)
            columns, i = [t.word for t in toks[i + 1 : close] if t.kind == "name"], close + 1
        i += toks[i].is_("AS")
        close = _closing(toks, i)
        out.append((name, columns, sql[toks[i].end : toks[close].start]))
        if toks[close + 1].text != ",":
            return out, sql[toks[close + 1].start :]
        i = close + 2


def _closing(toks: list[Token], i: int) -> int:
    depth = 0
    for k in range(i, len(toks)):
        depth += (toks[k].text == "(") - (toks[k].text == ")")
        if not depth:
            return k
    raise ValueError("a bracket isn't closed")


def with_old_tables(sql: str, events: list[dict], pre: Columns, post: Columns, facts: Facts | None = None) -> str | None:
    """The query with definitions of the old tables that it reads in front of it, so that every name means what it did, in whatever scope.
    None where there is nothing to define, or a table is read by a qualified name, which no definition stands for."""
    held = outline(sql)
    read = {t.word.lower() for t in held.relations}
    names = lambda tables: {t: [c for c, _ in cs] for t, cs in tables.items()}
    used = None if held.whole() else {t.word.lower() for t in held.tokens if t.kind == "name"}
    before = {t: cs for t, cs in names(pre).items() if t.lower() in read}
    views = compatible_views(events, before, names(post), used, facts)
    if not views or held.qualified:
        return None
    defined = {t.lower() for t in views}
    crossing = any({r.word.lower() for r in outline(view).relations} & defined - {t.lower()} for t, view in views.items())
    if crossing:  # names are given only after all that is behind them is read
        steps = [(f"{t}_before", view) for t, view in views.items()] + [(t, f"SELECT * FROM {quoted(t + '_before')}") for t in views]
    else:
        steps = list(views.items())
    front = ", ".join(f"{quoted(t)} AS ({view})" for t, view in steps)
    toks = tokens(sql)
    if not toks[0].is_("WITH"):
        return f"WITH {front} {sql}"
    own = {name.lower() for name, _, _ in with_list(sql)[0]}
    if toks[1].is_("RECURSIVE") or own & {t.lower() for t, _ in steps}:
        return f"WITH {front} SELECT * FROM ({sql})"
    return f"WITH {front}, {sql[toks[0].end :].lstrip()}"


def separator(expression: str) -> str | None:
    """The literal that a concatenation puts between its first two operands."""
    found = re.search(r"\|\|\s*'((?:[^']|'')*)'\s*\|\|", expression or "")
    return found[1].replace("''", "'") if found else None


def guidance(events: list[dict]) -> str:
    """What a text generator must know about splits and merges, as plain rules."""
    out = []
    for e in events:
        if e["op"] == "COLUMN_MERGE":
            sources, target, how = ", ".join(e["sources"]), e["target"], e.get("expression", "")
            out.append(f"COLUMN_MERGE: {e['table']} has {target} in place of [{sources}]" + (f", made by {how}" if how else "") + f". Select {target} for any of them.")
            if "||" in how:
                sep = separator(how) or " "
                first, last = e["sources"][0], e["sources"][-1]
                out.append(f"- {first} = 'X' becomes {target} LIKE 'X{sep}%'; {last} = 'Y' becomes {target} LIKE '%{sep}Y'.")
                out.append(f"- {first} alone is SUBSTR({target}, 1, INSTR({target}, '{sep}') - 1).")
            out.append(f"- Group, sort and count distinct by the part of {target} that is meant.")
        elif e["op"] == "TABLE_SPLIT":
            out.append(f"TABLE_SPLIT: the columns of {e['source']} are in [{', '.join(e['targets'])}], which share {e['key']}.")
            out.append(f"- Read from those of them that hold a column in use, joined on {e['key']}.")
        elif e["op"] == "TABLE_MERGE":
            out.append(f"TABLE_MERGE: [{', '.join(e['sources'])}] are one table, {e['target']}" + (f", joined on {e['key']}." if e.get("key") else "."))
            out.append(f"- Read {e['target']} for each of them and drop the join between them.")
    return "\n".join(out)


def compatible_views(events: list[dict], pre: dict[str, list[str]], post: dict[str, list[str]], used: set[str] | None = None, facts: Facts | None = None) -> dict[str, str]:
    """SQL of a view under each old name. pre and post list tables' columns; used, if given, the columns a query names.

    A renamed table or column is a projection, which Catalyst inlines. A split table is the join of those targets that
    hold a column in use; with facts only targets go whose join neither drops nor repeats a row of the others, without
    them the key is taken to be unique and in all targets, as a split of a table with a unique key makes it. A merged column is
    given back by its separator, exactly if no value contains that. A merged table's parts are distinct projections, or
    plain ones where facts say that the key is unique: rows that the merge lost, and duplicates, don't come back.
    """
    lower = {t: {c.lower(): c for c in cs} for t, cs in post.items()}
    moved = {e["from"]: e["to"] for e in events if e["op"] == "TABLE_RENAME"}
    renamed = {(e["table"], e["from"].lower()): e["to"] for e in events if e["op"] == "COLUMN_RENAME"}
    merged = {(e["table"], s.lower()): (e, i) for e in events if e["op"] == "COLUMN_MERGE" for i, s in enumerate(e["sources"])}
    out = {}
    for table, columns in pre.items():
        split = next((e for e in events if e["op"] == "TABLE_SPLIT" and e["source"] == table), None)
        merge = next((e for e in events if e["op"] == "TABLE_MERGE" and table in e["sources"]), None)
        if split:
            need = [c for c in columns if used is None or c.lower() in used or c.lower() == split["key"].lower()]
            parts, place = [], {}
            for t in split["targets"]:
                held = [c for c in need if c.lower() in lower[t] and c.lower() not in place and c.lower() != split["key"].lower()]
                if held:
                    parts.append(t)
                    place |= {c.lower(): t for c in held}
            parts = parts or split["targets"][:1]
            if facts is not None:
                kept = [t for t in split["targets"] if t not in parts and not any(facts.matched_once(p, t) for p in parts)]
                parts = [t for t in split["targets"] if t in parts or t in kept]
            place[split["key"].lower()] = parts[0]
            joined = quoted(parts[0]) + "".join(f" JOIN {quoted(t)} ON {quoted(parts[0])}.{quoted(split['key'])} = {quoted(t)}.{quoted(split['key'])}" for t in parts[1:])
            out[table] = f"SELECT {', '.join(f'{quoted(place[c.lower()])}.{quoted(c)}' for c in need if c.lower() in place)} FROM {joined}"
        elif merge:
            every = facts is not None and merge["target"] in facts.unique
            out[table] = f"SELECT {'' if every else 'DISTINCT '}{', '.join(quoted(c) for c in columns if c.lower() in lower[merge['target']])} FROM {quoted(merge['target'])}"
        else:
            to = moved.get(table, table)
            if to not in post:
                continue
            picked = []
            for c in columns:
                if c.lower() in lower[to]:
                    picked.append(quoted(c))
                elif (to, c.lower()) in renamed:
                    picked.append(f"{quoted(renamed[to, c.lower()])} AS {quoted(c)}")
                elif (to, c.lower()) in merged and (sep := separator(merged[to, c.lower()][0].get("expression", ""))):
                    e, i = merged[to, c.lower()]
                    picked.append(f"split_part({quoted(e['target'])}, '{sep.replace(chr(39), chr(39) * 2)}', {i + 1}) AS {quoted(c)}")
            if picked and (to != table or len(picked) != len(post[to]) or any(" AS " in p for p in picked)):
                out[table] = f"SELECT {', '.join(picked)} FROM {quoted(to)}"
    return out
