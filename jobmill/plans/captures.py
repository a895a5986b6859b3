"""Invented captures of feeds and pages, in the shapes that the sources have, with nulls and broken entries. No query reads them but those over cases."""

from __future__ import annotations

import json

FEEDS = {
    "greenhouse": {
        "jobs": [
            {"id": 5501, "title": "Platform Engineer", "absolute_url": "https://boards.greenhouse.io/lipova/jobs/5501", "location": {"name": "Olomouc, Czechia"}, "offices": [{"name": "Olomouc"}], "content": "&lt;h3&gt;Your week&lt;/h3&gt;&lt;p&gt;Queues &amp;amp; streams&lt;/p&gt;", "updated_at": "2025-03-04T05:06:07Z"},
            {"id": 5502, "title": None, "absolute_url": "https://boards.greenhouse.io/lipova/jobs/5502"},
            {"id": 5503, "title": "Never linked", "absolute_url": None},
        ]
    },
    "lever": [
        {"id": "kx-9", "text": "Svelte Engineer", "hostedUrl": "https://jobs.lever.co/lipova/kx-9", "categories": {"location": "Remote - CEE"}, "descriptionPlain": "Maps that load quickly", "workplaceType": "remote", "createdAt": 1735689600000, "salaryRange": {"min": 3100, "max": 4700, "currency": "EUR"}},
        {"id": "kx-10", "text": "", "hostedUrl": "https://jobs.lever.co/lipova/kx-10", "categories": None},
    ],
    "ashby": {
        "jobs": [
            {"id": "m31", "title": "Analytics Lead", "jobUrl": "https://jobs.ashbyhq.com/lipova/m31", "location": "Liberec", "isRemote": False, "descriptionHtml": "<div>Numbers, <i>explained</i></div>", "compensation": {"compensationTierSummary": "90K CZK a month"}},
            {"id": None, "title": None, "jobUrl": None},
        ]
    },
    "recruitee": {
        "offers": [
            {"id": 61, "title": "Svelte Intern", "careers_url": "https://lipova.recruitee.com/o/intern", "city": "Zlín", "country": "Czech Republic", "remote": True, "description": "<p>Learn by doing</p>", "requirements": "<p>Curiosity</p>"},
            {"id": 62, "title": "Gone", "careers_url": "", "city": None, "country": None, "remote": None, "description": None, "requirements": None},
        ]
    },
    "workable": {
        "jobs": [
            {"shortcode": "QQ4", "title": "Office Manager", "url": "https://apply.workable.com/lipova/j/QQ4", "city": "Opava", "country": "Czechia", "telecommuting": False, "description": "<p>Plants and people</p>"},
            {"shortcode": "QQ5"},
        ]
    },
    "smartrecruiters": {
        "content": [
            {"id": "880", "name": "Site Reliability", "location": {"city": "Jihlava", "country": "cz", "remote": False}, "company": {"identifier": "Lipova"}, "releasedDate": "2025-02-01T00:00:00Z"},
            {"id": "881", "name": "", "location": None, "company": None},
        ]
    },
}
DETAILS = [("880", json.dumps({"jobAd": {"sections": {"one": {"text": "<p>Keep it up.</p>"}, "two": {"text": "<p>Write it down.</p>"}}}})), ("881", "{broken")]

FOUND = """<section>
<a class="result__a" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fprace.vzor.example%2Fmista%2Fsvelte&amp;rut=1">Svelte ve Vzoru</a>
<a class="result__a" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fwww.profesia.cz%2Fx%2F9&amp;rut=2">Svelte jinde</a>
<a class="result__a" href="https://www.prace.cz/nabidka/77/">Na desce</a>
<a class="result__a" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fprace.vzor.example%2Fmista%2Fsvelte&amp;rut=3">Ještě jednou</a>
<a class="result__a" href="https://www.linkedin.com/jobs/5">Za přihlášením</a>
<a class="plain" href="https://vzor.example/">Žádný výsledek</a></section>"""

HUB_URL = "https://rozcestnik.example/svelte-developer/"
HUB = """<main><ul>
<li><a href="/svelte-developer/">tato stránka</a></li>
<li><a href="/m/svelte-developer-opava-31">Svelte Developer v Opavě</a></li>
<li><a href="https://rozcestnik.example/m/svelte-developer-zlin-32?z=1#top">Svelte developer Zlín</a></li>
<li><a href="/m/kuchar-33">Kuchař</a></li>
<li><a href="https://jinam.example/m/svelte-developer-34">Svelte developer jinde</a></li>
</ul></main>"""

STRUCTURED = """<html><head><script type="application/ld+json">
{"@context": "https://schema.org", "@graph": [{"@type": "BreadcrumbList"}, {"@type": "JobPosting", "title": "Svelte Engineer", "description": "<ul><li>Maps</li><li>Charts</li></ul>",
 "datePosted": "2025-01-20", "hiringOrganization": {"@type": "Organization", "name": "Lipová dílna", "contactPoint": {"@type": "ContactPoint", "email": "mailto:prace@lipova.example"}},
 "jobLocation": [{"@type": "Place", "address": {"addressLocality": "Opava", "addressCountry": "CZ"}}],
 "baseSalary": {"@type": "MonetaryAmount", "currency": "CZK", "value": {"minValue": 41000, "maxValue": 52000, "unitText": "MONTH"}}}]}</script>
<script type="application/ld+json">{"@type": "JobPosting", </script>
<script type="application/ld+json">[{"@type": ["Thing", "JobPosting"], "name": "Kartograf", "jobLocationType": "TELECOMMUTE", "jobLocation": "Zlín"}, {"@type": "JobPosting", "title": null}]</script></head></html>"""

CONTACTS = """<html><head><script>var dsn = "https://k1@errors.example.io/2";</script></head><body>
<nav><a href="mailto:podpora@jobs.cz">podpora</a></nav><article>
<p>Ozvěte se na <a href="mailto:Lide@Lipova.Example?subject=Svelte">adresu</a> nebo vedeni@lipova.example.</p>
<p>Automat: no-reply@lipova.example, obrázek tym@3x.webp</p></article><footer>obchod@prace.cz</footer></body></html>"""

#: (board, page): cards with missing parts, a second card with the same address, and other links.
CARDS = [
    ("pracecz", """<section><div class="StackItem"><a data-testid="advert-link" href="/nabidka/41/">Zeměměřič</a><ul><li>Plat : 38 000 Kč</li><li>Název firmy : Kóty a spol.</li><li>Lokalita : Opava</li><li>Bez popisku</li></ul></div>
<div class="StackItem"><a data-testid="advert-link" href="/nabidka/41/">Zeměměřič podruhé</a></div><a data-testid="advert-link" href="/nabidka/42/">Bez karty</a></section>"""),
    ("startupjobs", """<a href="/nabidka/88/mapy"><h3>Kartograf</h3><p class="line-clamp-2">Mapová dílna</p><ul><li>Liberec</li><li>Hybrid</li></ul><ul><li>od 2 000 EUR</li><li>Part-time</li></ul></a><a href="/firma/3">Firma</a>"""),
    ("jobstack", """<a class="jobpost-mainlink" href="/it-job/77"><h3>Správce</h3><b class="custom-profile-label--secondary">Dlouhá 12/3, Zlín</b><b class="custom-profile-label--secondary">Kóty</b><i class="custom-profile-label">Remote</i><u class="jobposts-item_salary">50 000 Kč</u></a>
<a class="jobpost-mainlink" href="/it-job/78"><h3>Tester</h3><b class="custom-profile-label--secondary">Kóty</b><b class="custom-profile-label--secondary">Zlín</b></a><a class="jobpost-mainlink" href="/blog/1"><h3>Článek</h3></a>"""),
    ("skilleto", """<section class="q_job_9"><a href="/jobs/61">\U0001f4cd Kartograf</a><a href="/company/4">Mapová dílna</a><i class="q_money">45 000*</i></section><a href="/jobs/62">Bez karty</a>"""),
    ("cocuma", """<a href="/job/mapy" title="Z titulku"><b class="job-thumbnail-company">Mapová dílna</b><b class="job-thumbnail-work-shedule">Zkrácený</b></a><a href="/jobs">Všechny</a>"""),
    ("jobscz", """<article class="SearchResultCard"><a data-jobad-id="5" href="https://www.jobs.cz/rpd/5/">Kartograf</a><i class="x_salary">60 000 Kč</i><div class="SearchResultCard__logo"><img alt="Mapová dílna"></div><footer><ul><li>Něco</li><li>Ostrava a okolí</li></ul></footer></article><article class="SearchResultCard">Bez odkazu</article>"""),
]

_LONG = " ".join(["Kreslíme mapy měst, lesů a vod pro každého, kdo chodí pěšky."] * 4)
#: (url, board, title, company, location, page as served, page as rendered): descriptions at each place where they can stand.
DETAILS_OF = [
    ("u1", "jobscz", "Kartograf", "Kóty", "Opava", f"""<html><head><meta name="description" content="Krátce"></head><body><div class="cp-detail__content"><p>Úvod</p><p>{_LONG}</p></div><p>Pište na lide@koty.example</p></body></html>""", None),
    ("u2", "jobscz", "Kartograf", "Kóty", "Opava", f"""<body><div class="cp-detail__content">Málo</div><section data-jobad="body"><ul><li>první</li><li>{_LONG}</li></ul></section></body>""", None),
    ("u3", "jobscz", "Kartograf", "Kóty", "Opava", f"""<body><div id="vacancy-detail"><script>x()</script>{_LONG}</div></body>""", None),
    ("u4", "jobscz", "Kartograf", "Kóty", "Opava", "<body>Nic</body>", f"""<body><div class="RichContent big">{_LONG}</div><a href="mailto:nabor@koty.example">napište</a></body>"""),
    ("u5", "jobscz", "Kartograf", "Kóty", "Opava", """<meta property="og:description" content=" Mapy pro pěší "><meta name="description" content="Jiné">""", None),
    ("u6", "jobscz", "Kartograf", None, "Opava", None, None),
    ("u7", "jobscz", "Kartograf", "Kóty", "", "<body>Nic</body>", "<body><main>Jen pár slov</main></body>"),
    ("u8", "cocuma", "Z karty", "Kóty", "Opava", f"""<body><h1> Kartograf  II </h1><div class="company-profile-component">{_LONG}</div><div class="company-profile-component">krátké</div></body>""", None),
    ("u9", "cocuma", "Z karty", "Kóty", "Opava", "<body><p>Celá stránka</p></body>", None),
]


def _thumbnails(page: int, names: list[tuple[str, str]], links: int) -> str:
    """A page of cards (address, title) with so many links in all."""
    cards = "".join(f'<a href="/job/{u}"><b class="job-thumbnail-title">{t}</b></a>' for u, t in names)
    return f"<main>{cards}{''.join(f'<a href=\"/job/x{page}-{k}\"></a>' for k in range(links - len(names)))}</main>"


#: (search, page, html): the first search ends at its second page, which is not full; the second one has full pages and one that is lost.
BROWSED = [
    (1, 1, _thumbnails(1, [("a", "Svelte Developer"), ("b", "Kuchař"), ("c", "Senior Svelte Engineer")], 10)),
    (1, 2, _thumbnails(2, [("a", "Svelte Developer again"), ("d", "Svelte Lead")], 9)),
    (1, 3, _thumbnails(3, [("e", "Svelte Tester")], 12)),
    (2, 1, _thumbnails(1, [("f", "Svelte Developer")], 11)),
    (2, 2, _thumbnails(2, [("f", "Svelte Developer")], 10)),
    (3, 1, None),
]
_POSITIONS = '<section class="q_job_1"><a href="/jobs/7">Svelte Developer</a></section><a href="/jobs/8">Kuchař</a>'
#: (search, rank, allowed, html): the page of the skill, then the page of the role.
TWO_PAGES = [
    (1, 0, True, _POSITIONS), (1, 1, True, _POSITIONS.replace("/jobs/7", "/jobs/9")),
    (2, 0, True, "<main>nic</main>"), (2, 1, True, _POSITIONS),
    (3, 0, False, None), (3, 1, True, _POSITIONS),
    (4, 0, True, '<a href="/jobs/8">Kuchař</a>'), (4, 1, None, _POSITIONS),
    (5, 0, True, None), (5, 1, True, None),
]
