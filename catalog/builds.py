"""Whole table builds over the driver tables: parts as occupations, line items as their pay and skills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog.tables import table
from gradus.plans import employers as plans
from gradus.plans import occupations, programs

HOME, NEIGHBOURS = "S3", ("S5", "S8", "S13")


def _base(key: Column) -> Column:
    group = F.floor(key / 4)
    return F.concat_ws("-", (10 + F.floor(group / 9000)).cast("string"), (1000 + group % 9000).cast("string"))


def _code(key: Column) -> Column:
    """Four parts share the first seven characters; two of them are the same code once it is clean."""
    tail = F.when(key % 4 == 0, ".00").when(key % 4 == 1, "").when(key % 4 == 2, ".02").otherwise(".03")
    return F.concat(_base(key), tail)


def _raw(spark, sf) -> DataFrame:
    key = F.col("p_partkey")
    code = F.when(key % 8 != 3, _code(key))
    return table(spark, sf, "part").select(code.alias("soc_code"), F.col("p_name").alias("occ_title"), key.alias("ordinal"))


def occupation_master(spark, sf):
    """The occupation master: pay with markers among it, rows without a state, skills under codes and their parents."""
    lines = table(spark, sf, "lineitem")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    placed = lines.join(o, lines.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
    code, order = _code(F.col("l_partkey")), F.col("l_orderkey") * 10 + F.col("l_linenumber")
    wages = placed.select(
        code.alias("OCC_CODE"), F.when(F.col("l_linenumber") % 4 > 0, F.concat(F.lit("S"), "c_nationkey")).alias("PRIM_STATE"),
        F.when(F.col("l_orderkey") % 7 == 0, "#").otherwise(F.col("l_extendedprice").cast("string")).alias("A_MEDIAN"),
    )
    skills = lines.where("l_partkey % 4 > 0").select(
        code.alias("O*NET-SOC Code"), F.when(F.col("l_linenumber") % 2 == 1, "IM").otherwise("LV").alias("Scale ID"),
        F.concat(F.lit("E"), F.col("l_suppkey") % 13).alias("Element Name"), order.alias("ordinal"),
    )
    tasks = lines.select(
        code.alias("O*NET-SOC Code"), F.when(F.col("l_linenumber") % 3 == 1, "Core").otherwise("Other").alias("Task Type"),
        F.concat(F.lit("T"), F.col("l_suppkey") % 5).alias("Task"), order.alias("ordinal"),
    )
    out = occupations.build_occupations(_raw(spark, sf), wages, skills, tasks, HOME, NEIGHBOURS)
    return out.select("soc_code", "occ_title", F.round("median_wage_me", 4).alias("median_wage_me"), "wage_source", "skill_description")


def training_programs(spark, sf):
    """Programs of four sources at the grain of mapped codes; nameless and unmapped ones go."""
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    name = F.when(k % 9 > 0, F.col("s_name"))
    college = F.concat(F.lit("C"), "s_nationkey")
    of = lambda r, *columns: s.where(k % 4 == r).select(*columns)
    url = F.concat(F.lit("https://a.b/"), k)
    short = s.select(college.alias("short"), F.concat(F.lit("College of "), "s_nationkey").alias("full")).distinct().where("short <> 'C3'")
    sources = [
        programs.community(of(0, college.alias("college"), name.alias("program_name"), F.lit("AAS").alias("credential"), url.alias("url")), short),
        programs.initiatives(of(1, name.alias("program_name"), F.lit("tools").alias("focus"), F.lit("all").alias("best_for"), url.alias("url"))),
        programs.university(
            of(2, college.alias("college"), F.lit("BS").alias("credential"), name.alias("program_name"), F.concat(F.lit("https://www.google.com/search?q="), url).alias("url"))
        ),
        programs.apprenticeships(of(3, name.alias("program_name")), "Sponsor", "https://s", ("Supplier#000000007",)),
    ]
    mapping = s.where("s_suppkey % 5 > 0").select(
        F.col("s_name").alias("program_name"), F.array(_base(k * 4), _base(k * 4 + 40), F.lit("00-0000")).alias("soc_codes")
    )
    return programs.build_programs(sources, mapping, occupations.clean_occupations(_raw(spark, sf)))


def employer_table(spark, sf):
    """Members and job boards at the grain of codes, with their own sites or search addresses."""
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    kind = F.when(k % 3 == 0, "General Contractors").when(k % 3 == 1, "Specialty Contractors").otherwise("Other")
    raw = c.select(kind.alias("agc_type"), F.when(k % 11 > 0, F.concat(F.lit(" "), "c_name", F.lit(" "))).alias("employer_name"), k.alias("ordinal"))
    site = lambda letter: F.when(F.col("c_nationkey") % 7 > 0, F.concat(F.lit(letter), "c_nationkey"))
    links = c.where(k % 5 == 0).select(F.upper("c_name").alias("company"), site("u").alias("url"), k.alias("ordinal")).unionByName(
        c.where(k % 10 == 0).select(F.col("c_name").alias("company"), site("v").alias("url"), (k + 1_000_000_000).alias("ordinal"))
    )
    mapping = c.where(k % 4 == 0).select(F.col("c_name").alias("employer_name"), F.array(_base(k * 4)).alias("soc_codes"))
    n = table(spark, sf, "nation")
    boards = n.select(
        F.col("n_name").alias("board"), F.when(F.col("n_nationkey") % 2 == 0, F.lower("n_name")).alias("url"),
        F.array(_base(F.col("n_nationkey") * 4), F.lit("10-1000")).alias("soc_codes"), F.lit("national").alias("scope"),
        F.col("n_nationkey").cast("bigint").alias("ordinal"),
    )
    titles = occupations.clean_occupations(_raw(spark, sf))
    full = F.array(F.lit("10-1000"), F.lit("10-1001.02"))
    members = plans.member_rows(plans.clean_members(raw), mapping, full, plans.company_links(links), titles, "https://s?q=", "&l=x")
    return plans.build_employers(members, plans.board_rows(boards, titles, "https://s?q=", "&l=x"))


QUERIES = {f.__name__: f for f in (occupation_master, training_programs, employer_table)}

_RAW = """
b as (select *, (10 + (p_partkey // 4) // 9000)::varchar || '-' || (1000 + (p_partkey // 4) % 9000)::varchar base from part),
raw as (select p_partkey k, p_name, replace(base || case p_partkey % 4 when 0 then '.00' when 1 then '' when 2 then '.02' else '.03' end, '.00', '') soc
        from b where p_partkey % 8 <> 3),
occ as (select soc, arg_min(p_name, k) title from raw group by 1)
"""

SQL = {
    "occupation_master": f"""with {_RAW},
        l as (select *, left(c, 7) parent, l_orderkey * 10 + l_linenumber o from (select lineitem.*, replace((10 + (l_partkey // 4) // 9000)::varchar || '-' ||
              (1000 + (l_partkey // 4) % 9000)::varchar || case l_partkey % 4 when 0 then '.00' when 1 then '' when 2 then '.02' else '.03' end, '.00', '') c from lineitem)),
        w as (select l.*, case when l_linenumber % 4 > 0 then 'S' || c_nationkey end st from l join orders on l_orderkey = o_orderkey
              join customer on o_custkey = c_custkey where l_orderkey % 7 > 0),
        m1 as (select c, avg(l_extendedprice) v from w where st = '{HOME}' group by 1),
        m2 as (select parent, avg(l_extendedprice) v from w where st = '{HOME}' group by 1),
        m3 as (select c, avg(l_extendedprice) v from w where st in {NEIGHBOURS} group by 1),
        m4 as (select c, avg(l_extendedprice) v from w where st is null group by 1),
        own as (select c, string_agg(e, ', ' order by o) txt from (select c, 'E' || (l_suppkey % 13) e, min(o) o from l
                where l_partkey % 4 > 0 and l_linenumber % 2 = 1 group by 1, 2) group by 1),
        par as (select parent, string_agg(txt, ', ' order by c) txt from (select left(c, 7) parent, txt, min(c) c from own group by 1, 2) group by 1),
        tk as (select c, string_agg(e, ', ' order by o) txt from (select c, 'T' || (l_suppkey % 5) e, min(o) o from l where l_linenumber % 3 = 1 group by 1, 2) group by 1)
        select soc soc_code, title occ_title, round(coalesce(m1.v, m2.v, m3.v, m4.v), 4) median_wage_me,
               case when m1.v is not null then 'home' when m2.v is not null then 'home_parent' when m3.v is not null then 'neighbour_avg'
                    when m4.v is not null then 'national' else 'Missing' end wage_source,
               'Tasks: ' || coalesce(tk.txt, '') || '. Skills: ' || coalesce(own.txt, par.txt, '') skill_description
        from occ left join m1 on m1.c = soc left join m2 on m2.parent = soc left join m3 on m3.c = soc left join m4 on m4.c = soc
        left join own on own.c = soc left join par on par.parent = soc left join tk on tk.c = soc""",
    "employer_table": f"""with {_RAW},
        c as (select *, c_custkey k, (10 + c_custkey // 9000)::varchar || '-' || (1000 + c_custkey % 9000)::varchar own from customer),
        m as (select k, c_name, own, case k % 3 when 0 then 'General Contractors' else 'Specialty Contractors' end agc
              from c where k % 3 < 2 and k % 11 > 0),
        site as (select k, case when k % 10 = 0 then 'v' else 'u' end || c_nationkey url from c where k % 5 = 0 and c_nationkey % 7 > 0),
        mc as (select m.*, unnest(case when agc = 'General Contractors' or k % 4 > 0 then ['10-1000', '10-1001.02'] else [own] end) soc from m),
        n as (select n_nationkey k, n_name, (10 + n_nationkey // 9000)::varchar || '-' || (1000 + n_nationkey % 9000)::varchar own from nation),
        bc as (select n.*, unnest([own, '10-1000']) soc from n),
        rows as (select mc.soc, c_name employer_name, agc agc_type,
                    coalesce(url, 'https://s?q=' || replace(coalesce(title, ''), ' ', '%20') || '&l=x') url,
                    case when url is not null then 'company_site' else 'indeed_fallback' end url_type, 'local_employer' source_type, title
                 from mc left join site using (k) left join occ on occ.soc = mc.soc
                 union all
                 select bc.soc, n_name, 'national', case when k % 2 = 0 then lower(n_name)
                    else 'https://s?q=' || replace(coalesce(f.title, ''), ' ', '%20') || '&l=x' end, 'job_board', 'job_board', occ.title
                 from bc left join occ on occ.soc = bc.soc left join occ f on f.soc = bc.own)
        select distinct soc soc_code, coalesce(title, '') occ_title, employer_name, agc_type, url, url_type, source_type from rows""",
    "training_programs": f"""with {_RAW},
        s as (select *, 'C' || s_nationkey col, 'https://a.b/' || s_suppkey u from supplier where s_suppkey % 9 > 0),
        src as (select s_suppkey k, s_name program_name, case when col = 'C3' then col else 'College of ' || s_nationkey end college, 'associate' program_type,
                       'AAS' credential, u url, 'community_college' source from s where s_suppkey % 4 = 0
                union all select s_suppkey, s_name, 'Workforce Initiative', 'bootcamp', 'tools', u, 'workforce_initiative' from s where s_suppkey % 4 = 1
                union all select s_suppkey, s_name, col, 'university', 'BS', u, 'university' from s where s_suppkey % 4 = 2
                union all select s_suppkey, s_name, 'Sponsor', 'apprenticeship', 'Apprenticeship', 'https://s', 'agc_apprenticeship' from s
                          where s_suppkey % 4 = 3 and s_name <> 'Supplier#000000007'),
        pairs as (select src.*, unnest([(10 + k // 9000)::varchar || '-' || (1000 + k % 9000)::varchar,
                  (10 + (k + 10) // 9000)::varchar || '-' || (1000 + (k + 10) % 9000)::varchar, '00-0000']) soc from src where k % 5 > 0)
        select pairs.soc soc_code, title occ_title, program_name, college, program_type, credential, url, source
        from pairs left join occ on occ.soc = pairs.soc""",
}
