"""Addresses of papers: direct candidates for known hosts, links in landing pages, and what may be fetched."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
META_PDF = (
    r"""(?i)<meta[^>]+name=["']citation_pdf_url["'][^>]*content=["']([^"']+)""",
    r"""(?i)<meta[^>]+content=["']([^"']+)["'][^>]*name=["']citation_pdf_url["']""",
    r"""(?i)<link[^>]+type=["']application/pdf["'][^>]*href=["']([^"']+)""",
)


def is_url(text: Column) -> Column:
    return F.trim(text).rlike("(?i)^https?://")


def candidate_urls(url: Column) -> Column:
    """Likely direct addresses, the given one last, without repeats."""
    u = F.trim(url)
    scheme, netloc, path = (F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)", k) for k in (1, 2, 3))
    host = F.regexp_replace(F.lower(netloc), r"^www\.", "")
    arxiv = F.regexp_extract(path, r"^/(?:abs|html|pdf)/(.+?)(?:\.pdf)?/?$", 1)
    base = F.regexp_replace(F.regexp_replace(path, r"(\.full(\.pdf)?|\.pdf|/)$", ""), r"\.(full|abstract|article-info)$", "")
    pmc = F.regexp_extract(F.when(host == "europepmc.org", u).otherwise(path), r"(PMC\d+)", 1)
    europe = F.concat(F.lit("https://europepmc.org/backend/ptpmcrender.fcgi?accid="), pmc, F.lit("&blobtype=pdf"))
    ncbi = host.isin("ncbi.nlm.nih.gov", "pmc.ncbi.nlm.nih.gov")
    first = (
        F.when((host == "arxiv.org") & (arxiv != ""), F.concat(F.lit("https://arxiv.org/pdf/"), arxiv))
        .when((host.endswith("biorxiv.org") | host.endswith("medrxiv.org")) & F.contains(path, F.lit("/content/")), F.concat(scheme, F.lit("://"), netloc, base, F.lit(".full.pdf")))
        .when((ncbi | (host == "europepmc.org")) & (pmc != ""), europe)
    )
    second = F.when(ncbi & (pmc != ""), F.concat(F.lit("https://pmc.ncbi.nlm.nih.gov/articles/"), pmc, F.lit("/pdf/")))
    return F.array_distinct(F.array_compact(F.array(first, second, u)))


def pdf_link(html: Column, base: Column) -> Column:
    """The first link to a PDF that a page declares, against the page's address; null if none."""
    found = F.coalesce(*(F.nullif(F.regexp_extract(html, p, 1), F.lit("")) for p in META_PDF))
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_extract(base, r"^[^?#]*", 0), r"/[^/]*$", "/")
    return (
        F.when(found.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), found)
        .when(found.startswith("//"), F.concat(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), found))
        .when(found.startswith("/"), F.concat(root, found))
        .otherwise(F.concat(folder, found))
    )


def is_pdf(content: Column) -> Column:
    """Whether the first 1024 bytes hold the mark of a PDF."""
    return F.instr(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"), "%PDF-") > 0


def is_public_host(host: Column) -> Column:
    """Whether a host is a public name or IPv4 address in plain form, and nothing else.

    False for null and empty hosts, names of one label, local and internal names, IPv6 and numbers in any other notation, and
    private, loopback, link-local, shared, multicast, documentation and reserved addresses. Names that resolve to such an address
    must be checked by the fetcher, which sees the address.
    """
    h = F.lower(F.rtrim(F.trim(host), F.lit(".")))
    quad = r"^(0|[1-9]\d{0,2})\.(0|[1-9]\d{0,2})\.(0|[1-9]\d{0,2})\.(0|[1-9]\d{0,2})$"
    a, b, c, d = (F.regexp_extract(h, quad, k).try_cast("int") for k in (1, 2, 3, 4))
    private = a.isin(0, 10, 127) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127)) | (a >= 224)
    reserved = ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 198) & b.isin(18, 19)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113))
    address = h.rlike(quad) & (F.greatest(a, b, c, d) <= 255) & ~private & ~reserved
    name = h.rlike(r"^(?:[a-z0-9_](?:[a-z0-9_-]{0,61}[a-z0-9_])?\.)+[a-z](?:[a-z0-9-]{0,61}[a-z0-9])$") & ~h.rlike(r"(?:^|\.)(?:localhost|local|internal|localdomain|home|lan|intranet|corp|private)$")
    return F.coalesce(address | name, F.lit(False))
