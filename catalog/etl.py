"""Table building: codes, wages, texts, programs, employers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.tables import table, wage_observations
from gradus import fixed
from gradus.functions import numeric, text
from gradus.operators import matching, ranking, tables

SEARCH = "https://jobs.example.org/search?q="


def _filled_wages(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select(
        F.col("p_partkey").alias("code"), F.when(F.col("p_size") > 25, F.col("p_type")).alias("parent_key")
    )
    state = F.col("state")
    levels = [
        tables.Level("exact", state == 7, "code", "code"),
        tables.Level("parent", state == 7, "parent", "parent_key"),
        tables.Level("neighbour", state.isin(6, 8, 9), "code", "code"),
        tables.Level("national", F.lit(True), "code", "code"),
    ]
    return tables.fallback_with_provenance(
        parts, wage_observations(spark, sf), "value", levels, "code", "wage", "wage_source"
    ).drop("parent_key")


def wage_fallback(spark, sf):
    filled = _filled_wages(spark, sf)
    manual = table(spark, sf, "part").where("p_size = 50").select(
        F.col("p_partkey").alias("code"), (F.col("p_retailprice") * 30).alias("wage"),
        F.lit("manual").alias("wage_source"),
    )
    return tables.patch(filled, manual, "code").withColumn("wage", F.round("wage", 4))


_FALLBACK_SQL = """
obs as (select l_partkey code, p_type parent, c_nationkey st, l_extendedprice v
        from lineitem join part on p_partkey = l_partkey join orders on o_orderkey = l_orderkey
        join customer on c_custkey = o_custkey),
a as (select code, avg(v) w from obs where st = 7 group by 1),
b as (select parent, avg(v) w from obs where st = 7 group by 1),
n as (select code, avg(v) w from obs where st in (6, 8, 9) group by 1),
t as (select code, avg(v) w from obs group by 1),
filled as (
  select p_partkey code,
         coalesce(a.w, case when p_size > 25 then b.w end, n.w, t.w) wage,
         case when a.w is not null then 'exact' when p_size > 25 and b.w is not null then 'parent'
              when n.w is not null then 'neighbour' when t.w is not null then 'national'
              else 'Missing' end wage_source
  from part left join a on a.code = p_partkey left join b on b.parent = p_type
  left join n on n.code = p_partkey left join t on t.code = p_partkey)
"""


def wage_source_audit(spark, sf):
    filled = _filled_wages(spark, sf)
    return (
        filled.groupBy("wage_source")
        .agg(F.count("*").alias("n"), F.count_if(F.col("wage").isNull()).alias("missing_wage"))
        .orderBy(F.desc("n"), "wage_source")
    )


def mean_excluding_states(spark, sf):
    """A NOT IN filter that keeps rows without a state."""
    obs = wage_observations(spark, sf).withColumn("state", F.expr("nullif(state, 3)"))
    kept = obs.where(~F.coalesce(F.col("state").isin(1, 2), F.lit(False)) & F.col("value").isNotNull())
    return kept.groupBy("parent").agg(F.round(F.avg("value"), 4).alias("mean_wage"), F.count("*").alias("n"))


def _raw_codes(spark, sf) -> DataFrame:
    n = F.col("p_partkey")
    code = F.concat(
        F.lit(" "), F.lpad((F.col("p_size") + 10).cast("string"), 2, "0"), F.lit("-"),
        (n % 97 + 1000).cast("string"), F.when(n % 3 == 0, ".00").when(n % 3 == 1, ".01").otherwise(""), F.lit(" "),
    )
    return table(spark, sf, "part").select(
        n.alias("ordinal"), F.when(n % 11 == 0, F.col("p_brand")).when(n % 13 != 0, code).alias("raw"), "p_name"
    )


def clean_codes_keep_first(spark, sf):
    listed = _raw_codes(spark, sf).withColumn("raw", text.strip(F.col("raw"))).where(text.is_code(F.col("raw")))
    cleaned = listed.select(text.clean_code(F.col("raw")).alias("soc_code"), "p_name", "ordinal")
    return tables.keep_first(cleaned, ["soc_code"], ["ordinal"])


def ordered_distinct_concat(spark, sf):
    events = table(spark, sf, "events")
    return tables.ordered_distinct_concat(events, ["user_id"], "event_type", "event_id", "skill_text")


def parent_text_fallback(spark, sf):
    """Own skill text, else the parent's, put together with task text."""
    l = table(spark, sf, "lineitem")
    order = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal")
    skills = l.where("l_returnflag = 'R'").select(
        F.col("l_partkey").alias("code"), order, F.concat("l_linestatus", F.lit("-"), F.col("l_quantity").cast("int").cast("string")).alias("element")
    )
    tasks = l.where("l_linestatus = 'O'").select(
        F.col("l_partkey").alias("code"), order, F.concat(F.lit("t"), F.col("l_suppkey").cast("string")).alias("task")
    )
    part = table(spark, sf, "part").select(
        F.col("p_partkey").alias("code"), F.concat("p_brand", F.col("p_size").cast("string")).alias("parent")
    )
    own = tables.ordered_distinct_concat(skills, ["code"], "element", "ordinal", "skill_own")
    by_parent = tables.parent_texts(part, skills, "code", "parent", "element", "ordinal", "skill_parent")
    task = tables.ordered_distinct_concat(tasks, ["code"], "task", "ordinal", "task_text")
    skill = F.coalesce("skill_own", "skill_parent")
    joined = part.join(own, "code", "left").join(task, "code", "left").join(by_parent, "code", "left")
    full = text.join_sections(F.col("task_text"), skill)
    return joined.select("code", full.alias("skill_description"), F.length(full).cast("bigint").alias("desc_len"))


def classify_text(spark, sf):
    credential = F.when(
        F.col("p_size") > 1,
        F.concat(
            F.when(F.col("p_type") == "SMALL", "Short-term ").otherwise(""),
            F.when(F.col("p_size") % 2 == 0, "AAS Degree").otherwise("Course"),
            F.when(F.col("p_size") % 3 == 0, ", Certificate").otherwise(""),
        ),
    )
    named = table(spark, sf, "part").withColumn("credential", credential)
    return named.select("p_partkey", text.credential_type(F.col("credential")).alias("program_type"))


def union_sources_mapped(spark, sf):
    nation = table(spark, sf, "nation")
    region = table(spark, sf, "region").select(F.col("r_regionkey").cast("string").alias("soc_code"), F.col("r_name").alias("occ_title"))
    names = nation.select(F.col("n_nationkey").alias("_n"), F.col("n_name").alias("program_name"))
    customer = table(spark, sf, "customer")
    supplier = table(spark, sf, "supplier")
    sources = [
        customer.join(names, customer.c_nationkey == names["_n"]).select(
            "program_name", F.col("c_name").alias("college"), F.col("c_mktsegment").alias("credential"),
            F.lit("community").alias("source"),
        ),
        supplier.join(names, supplier.s_nationkey == names["_n"]).select(
            "program_name", F.col("s_name").alias("college"), F.lit("initiative").alias("source")
        ),
    ]
    # Nations up to 2 have no code, the others their region and one that may not exist.
    mapping = nation.select(
        F.col("n_name").alias("program_name"),
        F.when(F.col("n_nationkey") > 2, F.array(F.col("n_regionkey").cast("string"), (F.col("n_nationkey") % 7).cast("string")))
        .otherwise(F.array().cast("array<string>")).alias("soc_codes"),
    )
    programs = tables.attach_codes(tables.union_aligned(sources), mapping, "program_name", "soc_codes", "soc_code")
    return programs.join(region, "soc_code", "left").orderBy("soc_code", "program_name", "college")


def coverage_report(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("code"))
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("code"))
    return tables.coverage(orders, lines, "code")


def coverage_missing(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("code"), "o_orderpriority")
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("code"))
    return tables.uncovered(orders, lines, "code")


def first_substring_match(spark, sf):
    """Employer links by name, with an encoded search address for the rest."""
    part = table(spark, sf, "part")
    links = part.select(
        text.strip(F.lower("p_type")).alias("company"),
        F.concat(F.lit("https://"), F.lower("p_brand")).alias("url"), F.col("p_partkey").alias("ordinal"),
    )
    links = tables.last_value_first_place(links, "company", "url", "ordinal").withColumn(
        "link_name", text.normalize_name(F.col("company"))
    )
    employers = part.select("p_partkey", "p_name", text.normalize_name(F.col("p_name")).alias("name"))
    matched = matching.first_match(
        employers, links, "p_partkey", "name", "link_name", "url", "ordinal", "found", min_length=4
    )
    return matched.select(
        "p_partkey",
        F.coalesce("found", text.search_url(F.col("p_name"), SEARCH, "&l=here")).alias("url"),
        F.when(F.col("found").isNotNull(), "company_site").otherwise("search_fallback").alias("url_type"),
    )


def passage_first_match(spark, sf):
    """Whole documents against whole passages: the earliest passage each contains."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("body"))
    items = table(spark, sf, "benchmark").withColumn("value", F.col("item_id"))
    found = matching.first_match(docs, items, "doc_id", "body", "text", "value", "item_id", "item")
    return found.select("doc_id", "item")


def expand_codes_dedup(spark, sf):
    customer = table(spark, sf, "customer")
    valid = F.array(*[F.lit(str(i)) for i in range(5)])
    members = customer.select(
        F.col("c_name").alias("employer_name"), F.col("c_mktsegment").alias("agc_type"),
        F.col("c_custkey").alias("ordinal"),
    )
    key = F.col("c_custkey")
    raw = (
        F.when(key % 7 == 0, F.lit('["GENERAL"]')).when(key % 7 == 1, F.lit("not json"))
        .when(key % 7 == 2, F.lit('["9","3","3"]'))
        .otherwise(F.concat(F.lit('["'), (F.col("c_nationkey") % 6).cast("string"), F.lit('","8"]')))
    )
    # Customers in debt were never mapped.
    mapping = customer.where("c_acctbal >= 0").select(
        F.col("c_name").alias("employer_name"), text.parse_codes(raw, valid).alias("soc_codes")
    )
    expanded = tables.expand_codes(
        members, mapping, "employer_name", "soc_codes", valid, F.col("agc_type") == "BUILDING", "GENERAL", "soc_code"
    ).withColumn("source_type", F.lit("local_employer"))
    boards = table(spark, sf, "supplier").select(
        F.concat(F.lit("Customer#"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("employer_name"),
        F.lit("national").alias("agc_type"), (F.col("s_suppkey") + 1_000_000_000_000).alias("ordinal"),
        (F.col("s_nationkey") % 5).cast("string").alias("soc_code"), F.lit("job_board").alias("source_type"),
    )
    both = tables.union_aligned([expanded, boards])
    first = tables.keep_first(both, ["soc_code", "employer_name"], ["ordinal"])
    return first.drop("ordinal").orderBy("soc_code", "source_type", "employer_name")


def incremental_cache(spark, sf):
    """Names already mapped keep their codes; only new ones reach the mapper."""
    customer = table(spark, sf, "customer")
    cached = customer.where("c_acctbal > 0").select(
        F.col("c_name").alias("employer_name"), F.array(F.col("c_mktsegment")).alias("soc_codes")
    )
    known = customer.select(F.col("c_name").alias("employer_name"), F.col("c_nationkey").cast("string").alias("_code"))

    def mapper(fresh: DataFrame) -> DataFrame:
        return fresh.join(known, "employer_name", "left").select(
            "employer_name", F.array(F.coalesce("_code", F.lit("GENERAL"))).alias("soc_codes")
        )

    full = tables.extend_cache(customer.select(F.col("c_name").alias("employer_name")), cached, "employer_name", mapper)
    return full.select("employer_name", F.array_join("soc_codes", ",").alias("codes"))


def parsed_codes(spark, sf):
    """JSON documents flattened to rows, with a default for entries that do not parse."""
    events = table(spark, sf, "events")
    codes = F.map_values(F.from_json("props", "map<string,int>"))
    return events.select("event_id", F.explode(F.coalesce(codes, F.array(F.lit(-1)))).alias("code"))


def encoded_titles(spark, sf):
    pages = table(spark, sf, "pages")
    return pages.select("page_id", text.search_url(F.col("url"), SEARCH).alias("search_url"),
                        text.unwrap_url(F.col("url"), r"https?://(www\.)?").alias("bare_url"))


def tier_and_bubble(spark, sf):
    wage = F.col("o_totalprice") / 3.0
    tier = numeric.tier(wage)
    return table(spark, sf, "orders").select(
        "o_orderkey", tier.alias("wealth_tier"),
        numeric.lookup(tier, fixed.TIER_RANGES).alias("wage_range"),
        numeric.lookup(tier, fixed.TIER_COLOURS, fixed.DEFAULT_COLOUR).alias("color"),
        numeric.bubble_size(wage).alias("size"),
        text.title_with_pay(F.col("o_orderpriority"), wage).alias("option_label"),
    )


def children_lists(spark, sf):
    """Orders of every customer as pages of an ordered list; nobody is left out."""
    orders = table(spark, sf, "orders")
    listed = ranking.pages(orders, ["o_custkey"], "o_orderkey", F.col("o_orderkey").cast("string"), "items")
    customer = table(spark, sf, "customer").select("c_custkey")
    joined = customer.join(listed, F.col("c_custkey") == F.col("o_custkey"), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "c_custkey", F.coalesce("page", F.lit(0)).alias("page"), F.size(items).alias("n_items"),
        F.array_join(items, ",").alias("items"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        wage_fallback, wage_source_audit, mean_excluding_states, clean_codes_keep_first,
        ordered_distinct_concat, parent_text_fallback, classify_text, union_sources_mapped,
        coverage_report, coverage_missing, first_substring_match, passage_first_match,
        expand_codes_dedup, incremental_cache, parsed_codes, encoded_titles, tier_and_bubble, children_lists,
    )
}

SPACES = r"[\s\x0B\x1C-\x1F\x85\p{Z}]+"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACES}|{SPACES}$', '', 'g')"


def _name(x: str) -> str:
    return _strip(f"rtrim({_strip(f'lower({x})')}, '.,inc lc')")


def _encode(x: str) -> str:
    return f"replace(url_encode({x}), '%2F', '/')"


SQL = {
    "wage_fallback": f"""with {_FALLBACK_SQL}
        select code, round(case when p_size = 50 then p_retailprice * 30 else wage end, 4) wage,
               case when p_size = 50 then 'manual' else wage_source end wage_source
        from filled join part on p_partkey = code""",
    "wage_source_audit": f"""with {_FALLBACK_SQL}
        select wage_source, count(*) n, count(*) filter (wage is null) missing_wage from filled group by 1""",
    "mean_excluding_states": """
        select p_type parent, round(avg(l_extendedprice), 4) mean_wage, count(*) n
        from lineitem join part on p_partkey = l_partkey join orders on o_orderkey = l_orderkey
        join customer on c_custkey = o_custkey
        where nullif(c_nationkey, 3) is null or c_nationkey not in (1, 2) group by 1""",
    "clean_codes_keep_first": """
        with raw as (
          select p_partkey ordinal, p_name,
                 trim(case when p_partkey % 11 = 0 then p_brand
                           when p_partkey % 13 <> 0 then
                             lpad((p_size + 10)::varchar, 2, '0') || '-' || (p_partkey % 97 + 1000)
                             || case p_partkey % 3 when 0 then '.00' when 1 then '.01' else '' end end) raw
          from part),
        ok as (select replace(raw, '.00', '') soc_code, p_name, ordinal from raw
               where regexp_matches(raw, '^[0-9]{2}-[0-9]{4}'))
        select soc_code, p_name, ordinal from ok
        qualify row_number() over (partition by soc_code order by ordinal) = 1""",
    "ordered_distinct_concat": """
        with f as (select user_id, event_type, min(event_id) o from events group by 1, 2)
        select user_id, string_agg(event_type, ', ' order by o) skill_text from f group by 1""",
    "parent_text_fallback": """
        with l as (select *, l_orderkey * 10 + l_linenumber o from lineitem),
        s1 as (select l_partkey code, l_linestatus || '-' || l_quantity::int e, min(o) o from l
               where l_returnflag = 'R' group by 1, 2),
        own as (select code, string_agg(e, ', ' order by o, e) t from s1 group by 1),
        t1 as (select l_partkey code, 't' || l_suppkey e, min(o) o from l where l_linestatus = 'O' group by 1, 2),
        task as (select code, string_agg(e, ', ' order by o, e) t from t1 group by 1),
        p as (select p_partkey code, p_brand || p_size parent from part),
        p1 as (select parent, t, min(own.code) o from own join p using (code) group by 1, 2),
        par as (select parent, string_agg(t, ', ' order by o) t from p1 group by 1),
        x as (select p.code, 'Tasks: ' || coalesce(task.t, '') || '. Skills: '
                     || coalesce(own.t, par.t, '') skill_description
              from p left join own on own.code = p.code left join par on par.parent = p.parent
              left join task on task.code = p.code)
        select code, skill_description, length(skill_description)::bigint desc_len from x""",
    "classify_text": """
        with c as (select p_partkey, lower(case when p_size > 1 then
                     case when p_type = 'SMALL' then 'Short-term ' else '' end
                     || case when p_size % 2 = 0 then 'AAS Degree' else 'Course' end
                     || case when p_size % 3 = 0 then ', Certificate' else '' end end) c from part)
        select p_partkey, case when c like '%short%' then 'certificate'
                               when c like '%aas%' and c like '%certificate%' then 'associate_or_certificate'
                               when c like '%aas%' then 'associate' when c like '%certificate%' then 'certificate'
                               else 'unknown' end program_type from c""",
    "union_sources_mapped": """
        with p as (
          select n_name program_name, c_name college, c_mktsegment credential, 'community' source
          from customer join nation on n_nationkey = c_nationkey
          union all
          select n_name, s_name, null, 'initiative' from supplier join nation on n_nationkey = s_nationkey),
        m as (select n_name program_name, n_regionkey::varchar soc_code from nation where n_nationkey > 2
              union all select n_name, (n_nationkey % 7)::varchar from nation where n_nationkey > 2)
        select soc_code, program_name, college, credential, source, r_name occ_title
        from p join m using (program_name) left join region on r_regionkey::varchar = soc_code""",
    "coverage_report": """
        with n as (select l_orderkey k, count(*) c from lineitem group by 1)
        select count(*) n_entities, count(c) n_covered, count(*) - count(c) n_missing, sum(c)::bigint n_children
        from orders left join n on k = o_orderkey""",
    "coverage_missing": """
        select o_orderkey code, o_orderpriority from orders
        where not exists (select 1 from lineitem where l_orderkey = o_orderkey)""",
    "first_substring_match": f"""
        with links as (
          select {_name("p_type")} link_name, min(p_partkey) o, arg_max('https://' || lower(p_brand), p_partkey) url
          from part group by {_strip("lower(p_type)")}, 1),
        m as (select p_partkey, arg_min(url, o) url from part join links
              on {_name("p_name")} = link_name
                 or (length(link_name) >= 4 and contains({_name("p_name")}, link_name)) group by 1)
        select p_partkey, coalesce(m.url, '{SEARCH}' || {_encode("p_name")} || '&l=here') url,
               case when m.url is null then 'search_fallback' else 'company_site' end url_type
        from part left join m using (p_partkey)""",
    "passage_first_match": """
        select doc_id, (select min(item_id) from benchmark b
                        where length(b.text) >= 6 and contains(d.text, b.text)) item
        from documents d""",
    "expand_codes_dedup": """
        with valid as (select unnest(['0', '1', '2', '3', '4']) soc_code),
        own as (
          select c_custkey, unnest(case
            when c_mktsegment = 'BUILDING' or c_acctbal < 0 or c_custkey % 7 in (0, 1)
                 or (c_custkey % 7 > 2 and c_nationkey % 6 = 5) then ['0', '1', '2', '3', '4']
            when c_custkey % 7 = 2 then ['3'] else [(c_nationkey % 6)::varchar] end) soc_code from customer),
        u as (
          select soc_code, c_name employer_name, c_mktsegment agc_type, 'local_employer' source_type, 1 pref
          from own join customer using (c_custkey)
          union all
          select (s_nationkey % 5)::varchar, 'Customer#' || lpad(s_suppkey::varchar, 9, '0'), 'national', 'job_board', 2
          from supplier)
        select soc_code, employer_name, agc_type, source_type from u
        qualify row_number() over (partition by soc_code, employer_name order by pref) = 1""",
    "incremental_cache": """
        select c_name employer_name, case when c_acctbal > 0 then c_mktsegment else c_nationkey::varchar end codes
        from customer""",
    "parsed_codes": """
        select event_id, coalesce(json_extract(props, '$.k')::int, -1) code from events""",
    "encoded_titles": f"""
        select page_id, '{SEARCH}' || {_encode("url")} search_url,
               regexp_replace(url, 'https?://(www[.])?', '', 'g') bare_url from pages""",
    "tier_and_bubble": """
        with w as (select o_orderkey, o_orderpriority p, o_totalprice / 3.0::double w from orders),
        t as (select *, case when w < 55000 then 'Tier 1 — Entry/Support' when w < 80000 then 'Tier 2 — Technical Core'
                             when w < 110000 then 'Tier 3 — Senior/Specialist' else 'Tier 4 — Leadership/Expert' end t from w)
        select o_orderkey, t wealth_tier,
               case left(t, 6) when 'Tier 1' then '< $55,000' when 'Tier 2' then '$55,000 – $79,999'
                    when 'Tier 3' then '$80,000 – $109,999' else '$110,000+' end wage_range,
               case left(t, 6) when 'Tier 1' then '#94a3b8' when 'Tier 2' then '#60a5fa'
                    when 'Tier 3' then '#34d399' else '#fbbf24' end color,
               round_even(12 + (least(greatest(w, 40000), 150000) - 40000) / 110000 * 28, 0)::int size,
               p || ' — $' || round(w / 1000)::bigint || 'k' option_label
        from t""",
    "children_lists": """
        select c_custkey, 0 page, count(o_orderkey)::int n_items,
               coalesce(string_agg(o_orderkey::varchar, ',' order by o_orderkey), '') items
        from customer left join orders on o_custkey = c_custkey group by 1""",
}
