"""Candidate generation: a source row becomes itself, its preserving edits, its violating edits, and
the preserving edits of each of those. One pass, one Arrow-batched function."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gaugeframe.functions import lexer

SCHEMA = "item_id string, root_id string, parent_id string, pair_id string, kind string, edit string, side string, text string, contract_ok boolean, statement_changed boolean, skipped boolean"


def candidates(df: DataFrame, key: str, text: str, valid: str, seed: int = 17, preserving: tuple[str, ...] = tuple(lexer.PRESERVING), violating: tuple[str, ...] = tuple(lexer.VIOLATING), contents: bool = True) -> DataFrame:
    """An edit that does not apply gives a row with skipped true and no text. Sources that cannot be
    read (unterminated comment or string) give themselves alone, all edits skipped. The text is null
    unless ``contents``.

    Sources are dealt out evenly first: each costs about a millisecond, and a small file of many
    sources would be one task."""

    def tried(name: str, source: str, item: str):
        try:
            made = lexer.edit(name)(source, item, seed)
            lexer.header(made or "")  # a result without a declaration is no candidate
        except lexer.LexError:
            return None
        return None if made == source else made

    def rows(item: str, source: str, ok: bool):
        yield (item, item, None, None, "root", None, "positive" if ok else "negative", source, None, None, False)
        roots = [(item, source, None, "positive" if ok else "negative")]
        for name in violating if ok else ():
            made = tried(name, source, item)
            me = f"{item}/{name}"
            yield (me, item, item, me, "counter", name, "negative", made, None, None if made is None else lexer.statement_changed(source, made), made is None)
            if made is not None:
                roots.append((me, made, me, "negative"))
        for parent, body, pair, side in roots:
            for name in preserving:
                made = tried(name, body, parent)
                yield (f"{parent}/{name}", item, parent, pair, "variant", name, side, made, None if made is None else lexer.contract(name, body, made)[0], None, made is None)

    def run(batches):
        import pyarrow as pa

        kinds = {"string": pa.string(), "boolean": pa.bool_()}
        fields = [(x.split()[0], kinds[x.split()[1]]) for x in SCHEMA.split(", ")]
        for batch in batches:
            for low in range(0, batch.num_rows, 256):  # a source becomes some twenty rows
                part = batch.slice(low, 256)
                made = [r for item, source, ok in zip(*[c.to_pylist() for c in part.columns], strict=True) for r in rows(item, source or "", bool(ok))]
                columns = list(zip(*made, strict=True)) or [()] * len(fields)
                if not contents:
                    columns[7] = [None] * len(made)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])

    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.select(df[key].cast("string"), text, valid).repartition(tasks).mapInArrow(run, SCHEMA)
