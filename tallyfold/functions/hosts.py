"""What hosts, mail domains and DNS records say."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import host_of, ladder, normalize_name

# Mail domains of the public, mail providers by host, government clouds, tools by TXT prefix or SPF host.
FREE_MAIL = "gmail.com googlemail.com outlook.com hotmail.com live.com yahoo.com icloud.com me.com aol.com proton.me protonmail.com gmx.com gmx.de mail.com zoho.com qq.com 163.com".split()
MAIL_PROVIDERS = [(r"(google|googlemail)\.com$", "google"), (r"(outlook|office365)\.(com|us)$", "microsoft"), (r"zoho\.(com|eu)$", "zoho"), (r"protonmail\.ch$", "proton")]
GOV_CLOUD = r"(office365\.us|outlook\.us|\.gov|\.mil)$"
TOOLS = [("txt", "atlassian-domain-verification=", "atlassian"), ("txt", "docusign=", "docusign"), ("txt", "stripe-verification=", "stripe"), ("spf", "sendgrid.net", "sendgrid"), ("spf", "hubspotemail.net", "hubspot"), ("spf", "mailgun.org", "mailgun")]


def spf_hosts(txt: Column) -> Column:
    """Hosts that SPF records in an array of TXT records include."""
    own = F.filter(txt, lambda r: F.lower(r).startswith("v=spf1"))
    return F.array_distinct(F.flatten(F.transform(own, lambda r: F.regexp_extract_all(F.lower(r), F.lit(r"include:([^\s]+)"), F.lit(1)))))


def mail_provider(mx: Column) -> Column:
    """The provider that any of the MX hosts belongs to; 'other' if none is known, null without a host."""

    def any_of(pattern: str) -> Column:
        return F.exists(mx, lambda h: F.lower(h).rlike(pattern))

    known = ladder(*[(any_of(p), F.lit(name)) for p, name in MAIL_PROVIDERS], otherwise=F.lit("other"))
    return F.when(F.size(mx) > 0, known)


def on_gov_cloud(mx: Column, ns: Column, txt: Column) -> Column:
    hit = lambda arr: F.exists(arr, lambda h: F.lower(h).rlike(GOV_CLOUD))
    return hit(mx) | hit(ns) | hit(spf_hosts(txt))


def tools(txt: Column) -> Column:
    """Tools in use, sorted: by what their TXT record begins with or their host in SPF."""
    spf = spf_hosts(txt)

    def has(kind: str, key: str) -> Column:
        return F.exists(txt, lambda r: F.lower(r).startswith(key)) if kind == "txt" else F.exists(spf, lambda h: h.endswith(key))

    found = [F.when(has(kind, key), F.lit(name)) for kind, key, name in TOOLS]
    return F.array_sort(F.filter(F.array(*found), lambda x: x.isNotNull()))


def shown_label(host: Column, domain: Column, vocabulary: Sequence[str]) -> Column:
    """Of a host under a domain the words nearest the domain that are all in the vocabulary, as in 'api.eu'; null if there are none. Words that aren't are never shown."""
    labels = F.reverse(F.split(F.substring(host, F.lit(1), F.length(host) - F.length(domain) - 1), r"\."))
    known = F.array(*[F.lit(v) for v in vocabulary])
    good = lambda label: F.size(F.array_except(F.split(label, "-"), known)) == 0
    zero = F.struct(F.lit(True).alias("on"), F.array().cast("array<string>").alias("kept"))
    walked = F.aggregate(labels, zero, lambda acc, x: F.struct((acc["on"] & good(x)).alias("on"), F.when(acc["on"] & good(x), F.array_append(acc["kept"], x)).otherwise(acc["kept"]).alias("kept")))
    kept = F.array_join(F.reverse(walked["kept"]), ".")
    return F.when(host.endswith(F.concat(F.lit("."), domain)) & (kept != ""), kept)


def mail_domain(email: Column) -> Column:
    d = F.lower(F.regexp_extract(email, r"@([A-Za-z0-9.-]+\.[A-Za-z]{2,})\s*$", 1))
    return F.when((d != "") & ~d.isin(FREE_MAIL) & ~d.rlike(r"\.(edu|gov|mil)$"), d)


def company_mail_domain(email: Column, company: Column) -> Column:
    """The mail's domain if it carries the company's first word, or stands inside its squeezed name."""
    d = mail_domain(email)
    words = F.split(normalize_name(company), " ")
    label = F.substring_index(d, ".", 1)
    return F.when(((F.length(F.element_at(words, 1)) >= 3) & label.contains(F.element_at(words, 1))) | F.array_join(words, "").contains(label), d)


def search_keys(domain: Column, login: Column, name: Column) -> Column:
    """Keys to look an entity up by, strongest first: domain, login, a name of two words or more."""
    norm = normalize_name(name)
    keys = F.array(F.when(domain.isNotNull(), F.concat(F.lit("domain:"), host_of(domain))), F.when(login.isNotNull(), F.concat(F.lit("github:"), F.lower(login))), F.when(norm.contains(" "), F.concat(F.lit("name:"), norm)))
    return F.filter(keys, lambda k: k.isNotNull())
