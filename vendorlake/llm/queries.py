"""The queries op1 to op13 over the given tables, and the SQL that DuckDB can check them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import chunk_dedup, decontaminate, jaccard_join, langid, licenses, line_quality, multi_index, periodic, pii, prefix_trie, toxicity
from .bpe import encode_decode
from .shipping import ship
from .token_counts import token_counts


def tokenizer(name: str) -> str:
    """Where a public vocabulary lies; the package is imported only when a query asks for it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_col: str = "doc_id"):
    """Documents that no model learns from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item whose shingles it holds for the most part, over both whole tables."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, by a model of the labelled documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "n_words", "n_switches")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, as their number and digest, and the digest of the text that they decode to."""
    coded = encode_decode(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group of near copies: 0.85 and more of the four-word shingles alike."""
    return jaccard_join.similar_groups(table(spark, sf_dir, "documents"), width=4, part=85, whole=100)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that shares a passage with another one, with the passages' spans."""
    return chunk_dedup.repeated_spans(table(spark, sf_dir, "documents"))


def op6_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest vectors of each twentieth vector, over the whole table."""
    vectors = table(spark, sf_dir, "embeddings")
    return multi_index.search(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of tokens, and whether a context of 4,096 holds them."""
    counted = token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's license phrases and the labels of the templates that it holds."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, by models of the labelled documents that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.score(docs, toxicity.fit(labels.where(~held_out()), docs))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data: what the patterns find, and the spans of terms that give it away."""
    found = pii.sanitise(table(spark, sf_dir, "documents"), texts=False)
    count = lambda k: F.size(F.filter("hits", lambda h: h["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{pii.KINDS[k]}") for k in range(4)),
        F.sha2(pii.span_names(F.col("hits")), 256).alias("base_sha256"), pii.span_names(F.col("hits"), F.col("terms")).alias("spans"),
    )


def op11_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts, whether the base rules reject it, and whether it is kept by the share of its lines that are content."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    judged = line_quality.judge(docs, line_quality.fit(labels.where(~held_out()), docs))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share", "n_lines")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's periodic runs, the longest by its number of periods, and digests of all runs and of the text without repeats."""
    docs = table(spark, sf_dir, "documents").select("doc_id", periodic.replanted(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic.periodic_runs(docs)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "longest.start", "longest.length", "longest.period", F.expr("1000 * longest.length div longest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of the rebuilt conversations' beginnings, with what its subtree holds."""
    turns = prefix_trie.grafted(prefix_trie.ordered(table(spark, sf_dir, "conversations")))
    return prefix_trie.rollup(turns).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontaminate,
        op2_language_id,
        op3_bpe,
        op4_ngram_jaccard_join,
        op5_substring_dedup,
        op6_multi_index,
        op7_token_counts,
        op8_license_scans,
        op9_toxicity,
        op10_pii,
        op11_line_quality,
        op12_periodic_runs,
        op13_prefix_trie,
    )
}

_LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_SPACED = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"


def _shingled(words: str, width: int) -> str:
    """The shingles of a list of words, a shorter list being one."""
    return f"case when len({words}) < {width} then [array_to_string({words}, ' ')] else [array_to_string({words}[i:i + {width - 1}], ' ') for i in range(1, len({words}) - {width - 2})] end"


def _listed(text: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in text.split()) + "]"


def _places(phrase: str) -> str:
    n = len(phrase.split())
    return f"[i for i in range(0, len(w) - {n - 1}) if w[i + 1:i + {n}] = {_listed(phrase)}]"


def _templates() -> str:
    """(label, distinct words, least number of them, block length, telling word or null) of each template."""
    rows = ((label, text.split(), sorted(set(text.split()))) for label, text in licenses.TEMPLATES.items())
    telling = {label: f"'{w}'" for label, w in licenses.TELLING.items()}
    return ", ".join(f"('{label}', {_listed(' '.join(own))}, {-(-80 * len(own) // 100)}, {len(words)}, {telling.get(label, 'null')})" for label, words, own in rows)


def _crc32(text: str) -> str:
    """The CRC-32 of an ASCII text, by a table that the polynomial gives."""
    step = "case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end"
    entries = f"list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: {step}))"
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {codes}), lambda c, b: xor(c >> 8, ({entries})[(xor(c, b) & 255) + 1])), 4294967295)"


_BASE = {label: f"p{i}" for i, label in enumerate(licenses.PHRASES.values())}
#: DuckDB's SQL for the queries that it can express.
ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": f"""
        with d as (select doc_id, {_WORDS.format(_LOWERED.format("text"))} as w from documents), b as (select item_id, {_WORDS.format(_LOWERED.format("text"))} as w from benchmark),
        ds as (select distinct doc_id, unnest({_shingled("w", 5)}) as s from d where len(w) > 0), bs as (select distinct item_id, unnest({_shingled("w", 5)}) as s from b where len(w) > 0),
        q as (select item_id, count(*) as n_shingles from bs group by item_id)
        select doc_id, item_id, n_shingles, count(*) as n_shared, count(*) / n_shingles as containment
        from ds join bs using (s) join q using (item_id) group by doc_id, item_id, n_shingles having 100 * count(*) >= 80 * n_shingles
    """,
    "op4_ngram_jaccard_join": f"""
        with recursive d as (select doc_id, coalesce({_SPACED.format(_LOWERED.format("text"))}, []) as w from documents),
        s as (select distinct doc_id, unnest({_shingled("w", 4)}) as g from d where len(w) > 0), n as (select doc_id, count(*) as n from s group by doc_id),
        both_ as (select a.doc_id as x, b.doc_id as y, count(*) as i from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
        links as (select x, y from both_ join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * i >= 85 * (nx.n + ny.n - i)),
        edges as (select x, y from links union all select y, x from links),
        reach as (select x, y from edges union select r.x, e.y from reach r join edges e on r.y = e.x)
        select doc_id, coalesce(n.n, 0) as n_shingles, least(doc_id, coalesce(min(y), doc_id)) as component_id
        from d left join n using (doc_id) left join reach on reach.x = doc_id group by doc_id, n.n
    """,
    "op8_license_scans": f"""
        with d as (select doc_id, {_WORDS.format(_LOWERED.format("coalesce(text, '')"))} as w from documents), base as (
            select doc_id, len(w) as n_words, {", ".join(f"{_places(p)} as {_BASE[label]}" for p, label in licenses.PHRASES.items())} from d
        ), templates(label, words, need, size, telling) as (values {_templates()}),
        may as (select * from d join templates on len(list_intersect(w, words)) >= need and (telling is null or list_contains(w, telling))),
        blocks as (select doc_id, label, words, need, telling, unnest([w[i:i + size - 1] for i in range(1, len(w) + 1)]) as block from may),
        met as (select doc_id, label, max(len(list_intersect(block, words)) / len(words)) as c from blocks
            where len(list_intersect(block, words)) >= need and (telling is null or list_contains(block, telling)) group by doc_id, label),
        more as (select doc_id, list(label) as labels, max(c) as best, count(*) as n_templates from met group by doc_id),
        named as (
            select *, list_concat({", ".join(f"case when len({c}) > 0 then ['{label}'] else []::varchar[] end" for label, c in _BASE.items())}) as own,
                list_concat({", ".join(_BASE.values())}) as places from base
        )
        select doc_id, n_words, len(places) as n_base, list_min(places) as first_word, list_max(places) as last_word, array_to_string(list_sort(own), ',') as base_labels,
            array_to_string(list_sort(list_distinct(list_concat(own, coalesce(labels, [])))), ',') as labels,
            case when len(own) > 0 then 1.0::double else coalesce(best, 0.0)::double end as score, coalesce(n_templates, 0) as n_templates
        from named left join more using (doc_id)
    """,
    "op13_prefix_trie": f"""
        with t as (
            select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as pos
            from conversations where conv_id is not null
        ), convs as (select conv_id, {_crc32("conv_id::varchar")} % {prefix_trie.HEAD} as h, conv_id - conv_id % {prefix_trie.SHARED} as base from (select distinct conv_id from t)),
        heads as (select c.conv_id, pos, role, text from convs c join t on t.conv_id = c.base and pos < h),
        rebuilt as (select conv_id, 0 as part, pos, role, text from heads union all select conv_id, 1, pos, role, text from t join convs using (conv_id) where pos >= h),
        seqs as (select conv_id, list({{'r': role, 't': text}} order by part, pos) as turns from rebuilt group by conv_id),
        every as (select conv_id, coalesce(turns, []) as turns from convs left join seqs using (conv_id)),
        paths as (select conv_id, depth, sha256(to_json(turns[1:depth])::varchar) as node, sha256(to_json(turns[1:depth - 1])::varchar) as parent,
                len(turns) as n, coalesce(length(turns[depth].t), 0) as chars from (select *, unnest(range(len(turns) + 1)) as depth from every)),
        nodes as (select node, depth, min(parent) as parent, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * max(chars) as saved,
                sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (n = depth), '')) as ends_sha256 from paths group by node, depth),
        children as (select parent as node, depth - 1 as depth, count(*) as n_children from nodes where depth > 0 group by parent, depth),
        own as (select nodes.*, coalesce(n_children, 0) as n_children from nodes left join children using (node, depth)),
        below as (select distinct a.node, a.depth, u.node as u, u.depth as u_depth from paths a join paths u on a.conv_id = u.conv_id and a.depth <= u.depth),
        sums as (select below.node, below.depth, count(*) filter (own.n_children = 0) as n_leaves, sum(own.saved)::bigint as saved_tokens
            from below join own on own.node = u and own.depth = u_depth group by below.node, below.depth)
        select own.conv_id, own.depth, p.conv_id as parent_conv_id, own.n_convs, own.n_children, n_leaves, saved_tokens, own.ends_sha256
        from own join sums using (node, depth) left join nodes p on own.depth > 0 and p.node = own.parent and p.depth = own.depth - 1
    """,
}
