"""DNS evidence and takeover candidates. Answers are a table; who makes it (a file, a lookup job) is up to the caller."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..config import Dns
from ..functions import domains as D
from ..ship import ship

#: Providers whose names can be claimed when left dangling: name, suffixes, where it is told of.
PROVIDERS: list[tuple[str, list[str], str]] = [
    ("Agile CRM", ["agilecrm.com"], "https://github.com/EdOverflow/can-i-take-over-xyz/issues/145"),
    ("Airee.ru", ["airee.ru"], "https://github.com/EdOverflow/can-i-take-over-xyz/issues/104"),
    ("Anima", ["animaapp.io"], "https://docs.animaapp.com/v1/launchpad/08-custom-domain.html"),
    ("AWS/Elastic Beanstalk", ["elasticbeanstalk.com"], "https://github.com/EdOverflow/can-i-take-over-xyz/issues/194"),
    ("AWS/S3", ["s3.amazonaws.com"], "https://github.com/EdOverflow/can-i-take-over-xyz/issues/36"),
    ("Bitbucket", ["bitbucket.io"], "https://github.com/EdOverflow/can-i-take-over-xyz/issues/97"),
    ("Discourse", ["trydiscourse.com"], "https://hackerone.com/reports/264494"),
    ("Fastly", ["fastly.net"], "https://github.com/EdOverflow/can-i-take-over-xyz"),
    ("Gemfury", ["furyns.com"], "https://khaledibnalwalid.wordpress.com/2020/06/25/gemfury-subdomain-takeover/"),
    ("Ghost", ["ghost.io"], "https://github.com/EdOverflow/can-i-take-over-xyz/issues/89"),
    ("GitHub Pages", ["github.io"], "https://github.com/EdOverflow/can-i-take-over-xyz"),
    ("HatenaBlog", ["hatenablog.com"], "https://github.com/EdOverflow/can-i-take-over-xyz"),
    ("Help Juice", ["helpjuice.com"], "https://help.helpjuice.com/en_US/using-your-custom-domain/how-to-set-up-a-custom-domain"),
    ("Help Scout", ["helpscoutdocs.com"], "https://docs.helpscout.net/article/42-setup-custom-domain"),
    ("Helprace", ["helprace.com"], "https://github.com/EdOverflow/can-i-take-over-xyz/issues/115"),
    ("Heroku", ["herokuapp.com", "herokudns.com"], "https://github.com/EdOverflow/can-i-take-over-xyz"),
    ("JetBrains", ["youtrack.cloud"], "https://www.jetbrains.com/help/youtrack/incloud/Domain-Settings.html"),
    ("LaunchRock", ["launchrock.com"], "https://github.com/EdOverflow/can-i-take-over-xyz/issues/74"),
    ("Microsoft Azure", ["azure-api.net", "azurecontainer.io", "azurecr.io", "azuredatalakestore.net", "azureedge.net", "azurehdinsight.net", "azurewebsites.net", "blob.core.windows.net", "cloudapp.azure.com", "cloudapp.net", "database.windows.net", "redis.cache.windows.net", "search.windows.net", "servicebus.windows.net", "visualstudio.com"], "https://github.com/EdOverflow/can-i-take-over-xyz/issues/35"),
    ("Netlify", ["netlify.app"], "https://github.com/EdOverflow/can-i-take-over-xyz"),
    ("Ngrok", ["ngrok.io"], "https://ngrok.com/docs#http-custom-domains"),
    ("Readme.io", ["readme.io"], "https://github.com/EdOverflow/can-i-take-over-xyz/issues/41"),
    ("Shopify", ["myshopify.com"], "https://github.com/EdOverflow/can-i-take-over-xyz"),
    ("Strikingly", ["s.strikinglydns.com"], "https://medium.com/@sherif0x00/takeover-subdomains-pointing-to-strikingly-5e67df80cdfd"),
    ("Surge.sh", ["na-west1.surge.sh"], "https://surge.sh/help/adding-a-custom-domain"),
    ("SurveySparrow", ["surveysparrow.com"], "https://help.surveysparrow.com/custom-domain"),
    ("Uberflip", ["read.uberflip.com"], "https://help.uberflip.com/hc/en-us/articles/360018786372-Custom-Domain-Set-up-Your-Hub-on-a-Subdomain"),
    ("Uptimerobot", ["stats.uptimerobot.com"], "https://exploit.linuxsec.org/uptimerobot-com-custom-domain-subdomain-takeover/"),
    ("Vercel", ["vercel-dns.com", "vercel.app"], "https://github.com/EdOverflow/can-i-take-over-xyz"),
    ("Wordpress", ["wordpress.com"], "https://github.com/EdOverflow/can-i-take-over-xyz/pull/176"),
    ("Worksites", ["worksites.net"], "https://github.com/EdOverflow/can-i-take-over-xyz/issues/142"),
    ("Zendesk", ["zendesk.com"], "https://github.com/EdOverflow/can-i-take-over-xyz"),
]

STATUSES = ("resolved", "nx_domain", "no_data", "serv_fail", "refused", "timeout", "transport_error")


def fingerprints(spark: SparkSession, providers: list[tuple[str, list[str], str | None]] = PROVIDERS) -> DataFrame:
    """(provider, suffix, reference), a row for each suffix."""
    return spark.createDataFrame([(p, s.strip().rstrip(".").lower(), u) for p, ss, u in providers for s in ss], "provider string, suffix string, reference string")


def merge_fingerprints(upstream: DataFrame, curated: DataFrame) -> DataFrame:
    """Providers by lower-cased name with all their valid suffixes, sorted; names and references of the curated list go first. Both: (provider, suffix, reference)."""
    both = curated.withColumn("at", F.lit(0)).unionByName(upstream.withColumn("at", F.lit(1)))
    s = D.dns_name(F.regexp_replace(F.trim("suffix"), r"^(\*\.)+", ""))
    both = both.withColumn("suffix", s).where(D.normalize(F.col("suffix")).isNotNull())
    return both.groupBy(F.lower(F.trim("provider")).alias("key")).agg(F.min_by("provider", F.struct("at", "provider")).alias("provider"), F.array_sort(F.collect_set("suffix")).alias("suffixes"), F.min_by("reference", F.struct("at", F.col("reference").isNull(), "reference")).alias("reference")).drop("key")


def lookup_domains(findings: DataFrame, observed: DataFrame | None) -> DataFrame:
    """The distinct names to look up: of findings, and for takeovers of all observations too."""
    names = findings.select("domain")
    return (names if observed is None else names.union(observed.select("domain"))).distinct()


class Pace:
    """Starts of lookups in a task, at least so many seconds apart; for several threads."""

    def __init__(self, seconds: float):
        self.seconds, self.next, self.lock = seconds, 0.0, threading.Lock()

    def wait(self) -> None:
        with self.lock:
            now = time.monotonic()
            at = max(now, self.next)
            self.next = at + self.seconds
        time.sleep(at - now)


def resolve(domains: DataFrame, concurrency: int = 16, lookup: Callable[[str], dict] | None = None, per_second: float | None = None) -> DataFrame:
    """schemas.DNS and ttl of each name by live lookups, `concurrency` at a time and `per_second` a second over all tasks.

    There are no more tasks than lookups at a time, and each has its share of both, so that a larger cluster does not ask
    more. lookup gives (domain, ips, cname_chain, error, ttl) of a name; without one, the servers that the machine of the
    task names are asked.
    """
    tasks = max(1, min(concurrency, int(domains.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    threads, pause = max(1, concurrency // tasks), tasks / per_second if per_second else 0.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from concurrent.futures import ThreadPoolExecutor

        from ..sources.resolver import Resolver

        ask, pace = lookup or Resolver(), Pace(pause)

        def one(domain: str) -> dict:
            pace.wait()
            return {"ttl": None} | ask(domain)

        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                rows = list(pool.map(one, batch["domain"]))
                yield pd.DataFrame(rows, columns=["domain", "ips", "cname_chain", "error", "ttl"], dtype=object)

    ship(domains.sparkSession)
    told = domains.select("domain").repartition(tasks, "domain").mapInPandas(run, "domain string, ips array<string>, cname_chain array<string>, error string, ttl bigint")
    return told.select("domain", "ttl", (F.size("ips") > 0).alias("resolved"), answer(F.col("ips"), D.classify_dns_error(F.col("error"))).alias("status"), "ips", "cname_chain", errors_of(F.col("error")).alias("errors"))


#: Seconds for which an answer is kept: at least, at most, and where it does not say; and what failed for a reason that may pass.
LEAST_TTL, MOST_TTL, USUAL_TTL, FAILED_TTL = 60, 86_400, 300, 60


def kept_until(answers: DataFrame, now: int, negative_ttl: int) -> DataFrame:
    """answers of resolve() with asked_at and expires_at (seconds since 1970)."""
    found = F.least(F.greatest(F.coalesce("ttl", F.lit(USUAL_TTL)), F.lit(LEAST_TTL)), F.lit(MOST_TTL))
    seconds = F.when(F.col("resolved"), found).when(F.col("status").isin("nx_domain", "no_data"), negative_ttl).otherwise(FAILED_TTL)
    return answers.withColumns({"asked_at": F.lit(now).cast("bigint"), "expires_at": F.lit(now).cast("bigint") + seconds.cast("bigint")}).drop("ttl")


def last_answers(rows: DataFrame, now: int) -> DataFrame:
    """Of kept answers the last of each name, if it was asked now or has not expired; one sum by name."""
    last = rows.where((F.col("expires_at") > now) | (F.col("asked_at") == now)).groupBy("domain").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "domain"]), "asked_at").alias("x"))
    return last.select("domain", "x.*")


CACHED = f"{schemas.DNS}, asked_at bigint, expires_at bigint"


def answered(names: DataFrame, options: Dns, now: int | None = None, lookup: Callable[[str], dict] | None = None) -> DataFrame:
    """schemas.DNS of names, by a table of answers kept in options.cache where there is one: only names without an answer, or with one that has expired, are looked up, once, and added to it."""
    spark, now = names.sparkSession, int(time.time()) if now is None else now
    columns = [c.split()[0] for c in schemas.DNS.split(", ")]
    asking = lambda rows: resolve(rows, options.concurrency, lookup, options.per_second)
    if not options.cache:
        return asking(names).select(*columns).persist()  # what uses the answers twice does not ask twice
    path = spark._jvm.org.apache.hadoop.fs.Path(options.cache)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    table = lambda: last_answers(spark.read.schema(CACHED).parquet(options.cache), now)
    due = names.join(table(), "domain", "left_anti") if there else names
    kept_until(asking(due), now, options.negative_ttl).select(*[c.split()[0] for c in CACHED.split(", ")]).write.mode("append").parquet(options.cache)
    return names.join(table(), "domain").select(*columns)


def compact_answers(spark: SparkSession, options: Dns, now: int | None = None) -> None:
    """Write the table of answers anew beside itself, without what has expired or was asked again, and put it in place."""
    now = int(time.time()) if now is None else now
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    old, new = fs_path(options.cache), fs_path(f"{options.cache}-{uuid.uuid4().hex}")
    last_answers(spark.read.schema(CACHED).parquet(options.cache), now).write.parquet(new.toString())
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(old, True)
    fs.rename(new, old)


def errors_of(error: Column) -> Column:
    return F.when(error.isNull(), F.array().cast("array<string>")).otherwise(F.array(error))


def answer(ips: Column, status: Column | None = None) -> Column:
    """Status of an answer: resolved if it has addresses."""
    return F.when(F.size(ips) > 0, "resolved").otherwise(status if status is not None else F.lit("no_data"))


def _items(kind: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))


def apply_dns(findings: DataFrame, dns: DataFrame) -> DataFrame:
    """findings with the reasons and evidence of the answer for their domain; without an answer as they are."""
    joined = findings.join(dns, "domain", "left")
    none = F.array().cast("array<string>")
    ips, chain, errors = (F.coalesce(c, none) for c in ("ips", "cname_chain", "errors"))
    shown = F.replace(F.col("status"), F.lit("_"), F.lit(""))
    named = F.array_join(F.transform(F.split("status", "_"), F.initcap), "")
    n = lambda a, word: F.concat(F.size(a).cast("string"), F.lit(f" {word}"), F.when(F.size(a) == 1, "").otherwise("es" if word.endswith("address") else "s"))
    said = F.array(
        F.when(F.col("resolved"), F.concat(F.lit("DNS resolved to "), n(ips, "IP address"))).when(F.col("status").isin("nx_domain", "no_data"), "DNS lookup did not return IP addresses").otherwise(F.concat(F.lit("DNS lookup ended with status "), named)),
        F.when(F.size(chain) > 0, F.concat(F.lit("DNS CNAME chain contains "), n(chain, "target"))),
    )
    head = F.array(F.struct(F.lit("dns.resolved").alias("kind"), F.col("resolved").cast("string").alias("value")), F.struct(F.lit("dns.status").alias("kind"), shown.alias("value")))
    known = F.col("resolved").isNotNull()
    return joined.select(
        *[c for c in findings.columns if c not in ("reasons", "evidence")],
        F.when(known, F.concat("reasons", F.filter(said, lambda x: x.isNotNull()))).otherwise(F.col("reasons")).alias("reasons"),
        F.when(known, F.concat(F.col("evidence"), head, _items("dns.ip", ips), _items("dns.cname", chain), _items("dns.error", errors))).otherwise(F.col("evidence")).alias("evidence"),
    ).select(*findings.columns)


def takeover_candidates(dns: DataFrame, providers: DataFrame) -> DataFrame:
    """(domain, provider, cname, reference) of names that have no address but a CNAME under a provider's suffix.

    Endings of each CNAME are joined to the suffixes by equality; providers is a list of vendors, broadcast if small.
    """
    dangling = dns.where(~F.col("resolved") & F.col("status").isin("nx_domain", "no_data")).select("domain", F.explode("cname_chain").alias("cname"))
    parts = F.split(D.dns_name(F.col("cname")), "[.]")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.size(parts) - i + 1, i), "."))
    few = providers.limit(10_001).count() <= 10_000
    return dangling.withColumn("suffix", F.explode(ends)).join(F.broadcast(providers) if few else providers, "suffix").select("domain", "provider", "cname", "reference").distinct()


def takeover_findings(candidates: DataFrame) -> DataFrame:
    pair = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("value"))
    reason = F.concat(F.lit("unresolved domain has CNAME target `"), "cname", F.lit("` matching takeover provider `"), "provider", F.lit("`"))
    evidence = F.array(pair("takeover.status", F.lit("candidate")), pair("takeover.provider", F.col("provider")), pair("takeover.cname", F.col("cname")), pair("takeover.reference", F.col("reference")))
    return candidates.select("domain", F.lit("takeover").alias("detector"), F.lit("high").alias("severity"), F.lit(70).alias("score"), F.array(reason).alias("reasons"), F.filter(evidence, lambda e: e["value"].isNotNull()).alias("evidence"))
