"""The operators over their whole tables, as registered queries, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, centroids, chat_format, divergence, exact_dedup, licenses, line_dedup, lm_score, mixing, ngram_join, sentencepiece, toxicity, wrappers
from .common import table

def held_out() -> Column:
    """Rows that learning never sees."""
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece.encode_pieces(docs, sentencepiece.load_model()).drop("text")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(*toxicity.training_sample(docs, table(spark, sf_dir, "labels")))
    return toxicity.score_toxicity(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigrams, with two steps of backoff."""
    return _lm_score(spark, sf_dir, 3)


def op3_lm_score_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lm_score(spark, sf_dir, 2)


def _lm_score(spark: SparkSession, sf_dir: str, order: int) -> DataFrame:
    scored = lm_score.backoff_scores(table(spark, sf_dir, "documents"), order)
    return scored.select("doc_id", "n_words", F.round("log_score", 3).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"select -7L conv_id, stack(2, 0L, 'user', '{said}', 1L, 'assistant', '{said}') as (turn, role, text)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.chat_digest(chat_format.format_chats(rows))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_decisions(table(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_digest(table(spark, sf_dir, "embeddings"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract_text(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_toxicity, op3_lm_score, op3_lm_score_bigrams, op4_license_scan, op5_exact_dedup, op6_ann, op7_mix, op8_chat_format, op9_line_dedup, op10_ngram_join, op11_centroids, op12_divergence, op13_html_text)}

_SPACES = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]+"

def _centroid_sql(p: centroids.Clustering = centroids.Clustering()) -> str:
    """The rounds written out; products of integers below 2**53 are exact in doubles."""
    assign = "select rid, vec_id, v, arg_min(cluster, (dist, cluster)) cluster, min(dist) dist from (select rid, vec_id, v, cluster, list_inner_product(v, v) + list_inner_product(c, c) - 2 * list_inner_product(v, c) dist from k, {c}) group by rid, vec_id, v"
    steps = [
        f"k as (select row_number() over () rid, vec_id, [floor({p.scale} * x::double) for x in embedding]::double[] v from embeddings where len(embedding) = {p.dim} and len([x for x in embedding if x is null or not isfinite(x)]) = 0)",
        f"c0 as (select row_number() over (order by sha256('{p.seed}:' || vec_id), v) - 1 cluster, v c from k qualify cluster < {p.k})",
    ]
    for r in range(1, p.rounds + 1):
        steps.append(f"a{r} as ({assign.format(c=f'c{r - 1}')})")
        steps.append(f"s{r} as (select cluster, i, sum(x::hugeint) s, count(*) n from (select cluster, generate_subscripts(v, 1) i, unnest(v) x from a{r}) group by all)")
        steps.append(f"m{r} as (select cluster, list(((s - ((s % n) + n) % n) // n)::double order by i) c from s{r} group by cluster)")
        steps.append(f"c{r} as (select cluster, coalesce(m.c, o.c) c from c{r - 1} o left join m{r} m using (cluster))")
    steps.append(f"f as ({assign.format(c=f'c{p.rounds}')})")
    return "with " + ",\n".join(steps) + f"""
        select vec_id, cluster::int cluster, dist::bigint distance, sum(dist::bigint) over (partition by cluster)::bigint cluster_inertia, sum(dist::bigint) over ()::bigint inertia,
               sha256(array_to_string([x::bigint for x in c.c], ',')) centroid_sha256
        from f join c{p.rounds} c using (cluster)"""


ORACLE_SQL = {
    "op12_divergence": r"""
        with d as (select row_number() over () rid, coalesce(lang, '') lang, coalesce(source, '') source, coalesce(text, '') t from documents),
        w as (select rid, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) term from d),
        vocab as (select lang, term, count(*) ln from w group by lang, term having count(distinct rid) >= 10),
        lv as (select lang, count(*) v, sum(ln) nn from vocab group by lang),
        own as (select lang, source, term, count(*) n from w join vocab using (lang, term) group by all),
        g as (select lang, source, coalesce(v, 0) v, coalesce(lv.nn, 0) ln, coalesce(o.nn, 0) n from (select distinct lang, source from d) left join lv using (lang) left join (select lang, source, sum(n) nn from own group by all) o using (lang, source)),
        p as (select g.lang, g.source, term, coalesce(o.n, 0) c, 1 + 1000000000::hugeint * (coalesce(o.n, 0) + 2) // (g.n + 2 * g.v) p, 1 + 1000000000::hugeint * (vocab.ln + 2) // (g.ln + 2 * g.v) q
              from g join vocab using (lang) left join own o using (lang, source, term)),
        pv as (select a.lang, a.source, b.source item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) x from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
        pairs as (select a.lang, a.source, 'pair' part, b.source item, coalesce(x, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source left join pv on pv.lang = a.lang and pv.source = a.source and pv.item = b.source),
        terms as (select lang, source, 'term' part, term item, ((p - q) * (p - q) // (p + q))::bigint as value from p where c > 0 and p > q)
        select *, row_number() over (partition by lang, source, part order by value desc, item)::int rank from (select * from pairs union all select * from terms) qualify part = 'pair' or rank <= 10""",
    "op11_centroids": _centroid_sql(),
    "op3_lm_score_bigrams": rf"""
        with w as (select row_number() over () rid, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') ws from documents),
        t as (select rid, i, ws[i] w, case when i > 1 then ws[i - 1] end c from (select rid, ws, unnest(generate_series(1, len(ws))) i from w)),
        uni as (select w, count(*) n from t group by w),
        bi as (select c, w, count(*) n from t where c is not null group by c, w),
        total as (select count(*) n from t),
        s as (select t.rid, case when t.c is null then ln(u.n / total.n) when b.n >= 2 then ln(b.n / cu.n) else ln(0.4) + ln(u.n / total.n) end l
              from t join uni u on u.w = t.w left join bi b on b.c = t.c and b.w = t.w left join uni cu on cu.w = t.c, total),
        d as (select rid, sum(l) l from s group by rid)
        select w.doc_id, cast(len(ws) as bigint) n_words, round(coalesce(d.l, 0.0), 3) log_score, round(d.l / len(ws), 6) mean_log_score
        from w left join d using (rid)""",
    "op3_lm_score": rf"""
        with w as (select row_number() over () rid, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') ws from documents),
        t as (select rid, i, ws[i] w, case when i > 1 then ws[i - 1] end c, case when i > 2 then ws[i - 2] end b from (select rid, ws, unnest(generate_series(1, len(ws))) i from w)),
        uni as (select w, count(*) n from t group by w),
        bi as (select c, w, count(*) n from t where c is not null group by c, w),
        tri as (select b, c, w, count(*) n from t where b is not null group by b, c, w),
        total as (select count(*) n from t),
        s as (select t.rid, case when t.c is null then ln(u.n / total.n)
                                 when t3.n >= 2 then ln(t3.n / c2.n)
                                 else case when t.b is null then 0 else ln(0.4) end
                                      + case when t2.n >= 2 then ln(t2.n / c1.n) else ln(0.4) + ln(u.n / total.n) end end l
              from t join uni u on u.w = t.w left join bi t2 on t2.c = t.c and t2.w = t.w left join uni c1 on c1.w = t.c
                   left join tri t3 on t3.b = t.b and t3.c = t.c and t3.w = t.w left join bi c2 on c2.c = t.b and c2.w = t.c, total),
        d as (select rid, sum(l) l from s group by rid)
        select w.doc_id, cast(len(ws) as bigint) n_words, round(coalesce(d.l, 0.0), 3) log_score, round(d.l / len(ws), 6) mean_log_score
        from w left join d using (rid)""",
    "op5_exact_dedup": rf"""
        with n as (select row_number() over () rid, doc_id, regexp_replace(coalesce(text, ''), '{_SPACES}', ' ', 'g') t from documents)
        select doc_id, min(doc_id) over g keep_id, count(*) over g group_size,
               row_number() over (partition by t order by doc_id nulls last, rid) = 1 kept, sha256(t) text_sha256
        from n window g as (partition by t)""",
    "op7_mix": rf"""
        with d as (select row_number() over () uid, doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) as bigint) size, coalesce(text, '') t from documents),
        k as (select *, case when length(t) > 0 then length(regexp_replace(t, '[0-9|#*$%&<>{{}}\[\]=+_~^\\/]', '', 'g')) / length(t) else 0.0 end share from d),
        e as (select uid, doc_id, source, size, -ln((cast(concat('0x', substr(md5('7:' || doc_id), 1, 12)) as bigint) + 1) / 281474976710657.0::double) / (0.5 + share) ek from k),
        s as (select source, sum(size) ss from e group by source),
        r as (select source, ss, [1.0, 2.0, 3.0][1 + (row_number() over (order by source nulls last) - 1) % 3]::double w from s),
        q as (select *, 3.0 * ss / w ratio, (sum(ss) over () - coalesce(sum(3.0 * ss) over b, 0)) / (sum(w) over () - coalesce(sum(w) over b, 0)) lv
              from r window b as (order by 3.0 * ss / w, source nulls last rows between unbounded preceding and 1 preceding)),
        l as (select coalesce(first(lv order by ratio, source nulls last) filter (where lv <= ratio), 0) level from q),
        t as (select source, ss, cast(least(3.0 * ss, level * w) as double) target from q, l),
        t2 as (select *, case when ss > 0 then cast(floor(target / ss) as bigint) else 0 end ep from t),
        t3 as (select *, target - ep * ss rest from t2),
        p as (select e.*, t3.ss, t3.target, t3.ep, t3.rest, sum(size) over (partition by e.source order by ek, doc_id, uid rows unbounded preceding) <= rest picked
              from e join t3 on e.source is not distinct from t3.source),
        g as (select source, first(rest) - sum(case when picked then size else 0 end) gap from p group by source),
        c as (select source, first(uid order by far, ek, doc_id, uid) last_uid from
              (select p.*, abs(p.size - g.gap) far from p join g on p.source is not distinct from g.source where not p.picked and abs(p.size - g.gap) < g.gap) group by source)
        select doc_id, size, cast(ss as bigint) source_size, target, cast(ep * size + case when picked or uid = last_uid then size else 0 end as bigint) taken
        from p left join c on p.source is not distinct from c.source""",
    "op8_chat_format": r"""
        with r as (select conv_id, turn, coalesce(role, '') role, coalesce(text, '') txt from conversations
                   union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        x as (select *, length(role) + length(txt) + length('<|turn|><|says|><|done|>')
                + len(regexp_extract_all(role || chr(10) || txt, '<\\*\|turn\|>|<\\*\|says\|>|<\\*\|done\|>|<\\*\|endoftext\|>|<\\*s>|<\\*/s>|\[\\*INST\]|\[\\*/INST\]')) f from r)
        select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || txt || chr(10), '' order by turn nulls first, role, txt)) turns_sha256,
               cast(coalesce(sum(length(txt)) filter (where role = 'assistant'), 0) as bigint) loss_chars,
               sha256(coalesce(string_agg(txt, '' order by turn nulls first, role, txt) filter (where role = 'assistant'), '')) loss_sha256,
               cast(sum(f) as bigint) formatted_chars
        from x group by conv_id""",
}
