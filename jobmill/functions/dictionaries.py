"""Word lists, patterns and numbers that results depend on."""

from __future__ import annotations

#: Cities in the order in which they are looked for, with their spellings after folding.
CITIES = (
    ("Praha", ("praha", "prague", "prag")),
    ("Brno", ("brno",)),
    ("Ostrava", ("ostrava",)),
    ("Plzeň", ("plzen", "pilsen")),
    ("Olomouc", ("olomouc",)),
    ("Liberec", ("liberec",)),
    ("Hradec Králové", ("hradec kralove",)),
    ("České Budějovice", ("ceske budejovice", "budweis")),
    ("Pardubice", ("pardubice",)),
    ("Zlín", ("zlin",)),
    ("Ústí nad Labem", ("usti nad labem",)),
    ("Jihlava", ("jihlava",)),
    ("Karlovy Vary", ("karlovy vary",)),
    ("Opava", ("opava",)),
    ("Mladá Boleslav", ("mlada boleslav",)),
    ("Kladno", ("kladno",)),
    ("Teplice", ("teplice",)),
    ("Frýdek-Místek", ("frydek mistek",)),
)

#: Skills in the order in which they are reported, with their spellings after folding.
SKILLS = (
    ("React", ("react", "reactjs")),
    ("React Native", ("react native",)),
    ("Vue", ("vue", "vuejs")),
    ("Angular", ("angular",)),
    ("Svelte", ("svelte",)),
    ("Next.js", ("next js", "nextjs")),
    ("Nuxt", ("nuxt",)),
    ("TypeScript", ("typescript",)),
    ("JavaScript", ("javascript", "es6")),
    ("HTML", ("html", "html5")),
    ("CSS", ("css", "css3", "sass", "scss", "less")),
    ("Tailwind", ("tailwind",)),
    ("Node.js", ("node js", "nodejs", "node")),
    ("Express", ("express",)),
    ("NestJS", ("nestjs", "nest js")),
    ("Python", ("python",)),
    ("Django", ("django",)),
    ("FastAPI", ("fastapi",)),
    ("Java", ("java",)),
    ("Spring", ("spring", "spring boot")),
    ("Kotlin", ("kotlin",)),
    ("Swift", ("swift",)),
    ("C#", ("csharp",)),
    (".NET", ("dotnet",)),
    ("C++", ("cpp",)),
    ("Go", ("golang",)),
    ("Rust", ("rust",)),
    ("PHP", ("php",)),
    ("Laravel", ("laravel",)),
    ("Symfony", ("symfony",)),
    ("Ruby", ("ruby", "rails")),
    ("Scala", ("scala",)),
    ("SQL", ("sql",)),
    ("PostgreSQL", ("postgresql", "postgres")),
    ("MySQL", ("mysql", "mariadb")),
    ("MongoDB", ("mongodb", "mongo")),
    ("Redis", ("redis",)),
    ("Elasticsearch", ("elasticsearch", "elastic")),
    ("GraphQL", ("graphql",)),
    ("REST", ("rest", "rest api")),
    ("gRPC", ("grpc",)),
    ("Docker", ("docker",)),
    ("Kubernetes", ("kubernetes", "k8s")),
    ("AWS", ("aws",)),
    ("Azure", ("azure",)),
    ("GCP", ("gcp", "google cloud")),
    ("Terraform", ("terraform",)),
    ("Ansible", ("ansible",)),
    ("Linux", ("linux",)),
    ("CI/CD", ("ci cd", "cicd")),
    ("Git", ("git",)),
    ("Jenkins", ("jenkins",)),
    ("GitLab", ("gitlab",)),
    ("Playwright", ("playwright",)),
    ("Cypress", ("cypress",)),
    ("Selenium", ("selenium",)),
    ("Jest", ("jest",)),
    ("Figma", ("figma",)),
    ("Flutter", ("flutter",)),
    ("Android", ("android",)),
    ("iOS", ("ios",)),
    ("Pandas", ("pandas",)),
    ("Spark", ("spark",)),
    ("Kafka", ("kafka",)),
    ("Airflow", ("airflow",)),
    ("Machine Learning", ("machine learning", "strojove uceni")),
    ("PyTorch", ("pytorch",)),
    ("TensorFlow", ("tensorflow",)),
    ("LLM", ("llm", "openai", "langchain")),
    ("Unity", ("unity",)),
    ("Unreal", ("unreal",)),
    ("Power BI", ("power bi", "powerbi")),
    ("Snowflake", ("snowflake",)),
)

#: Words of folded titles by level, first level wins.
SENIORITY = (
    ("lead", ("lead", "principal", "head of", "architect", "staff")),
    ("senior", ("senior", "sr")),
    ("junior", ("junior", "jr", "graduate", "absolvent", "trainee", "intern")),
    ("mid", ("medior", "mid", "middle", "intermediate")),
)
#: Lines of a CV that name a job, lines that don't, what follows a title in its line, a wish to work from home, spoken languages in folded text.
TITLE_WORDS = r"(?iu)developer|engineer|vývojář|programátor|analyst|analytik|manager|manažer|designer|tester|architect|architekt|lead|consultant|konzultant|administrator|specialist|specialista|scientist|devops"
NOT_A_TITLE = r"@|https?:|•|^[-–—*]"
TITLE_TRAILER = r"\s+[—–-]\s+.*$|\s*\(.*\)\s*$"
REMOTE_WISH = r"(^| )(remote|home ?office|vzdalen\w*|z domova)( |$)"
LANGUAGES = (
    ("English", ("english", "anglictina", "anglicky")),
    ("Czech", ("czech", "cestina", "cesky")),
    ("Slovak", ("slovak", "slovenstina", "slovensky")),
    ("German", ("german", "nemcina", "nemecky", "deutsch")),
    ("French", ("french", "francouzstina")),
    ("Spanish", ("spanish", "spanelstina")),
)
LEVELS = {"junior": "junior", "mid": "mid", "medior": "mid", "senior": "senior", "lead": "lead"}

#: Words of folded work types.
REMOTE = r"(^| )(remote|vzdalen[aey]?|home ?office|z domova|prace z domu|fully remote|100 remote)( |$)"
HYBRID = r"(^| )(hybrid|hybridni|hybridne|castecne z domova)( |$)"
ONSITE = r"(^| )(onsite|on site|office|kancelar)( |$)"

#: Currency and period by the first pattern found in salary text.
CURRENCIES = ((r"kč|czk|korun", "CZK"), (r"€|eur\b", "EUR"), (r"\$|usd\b", "USD"), (r"zł|pln\b", "PLN"), (r"£|gbp\b", "GBP"))
PERIODS = ((r"hod|hour|/\s*h\b", "hour"), (r"\bmd\b|\bden\b|\bday\b", "day"), (r"\brok|year|annum|p\.\s*a\.", "year"), (r"m[eě]s|month|/\s*m\b|mo\b", "month"))
CURRENCY_TOKENS = r"kč|kc\b|czk|eur|usd|pln|gbp|[€$£]"

#: Query parameters that tell visitors apart, not postings.
TRACKING_PARAMS = ("searchid", "rps", "ref", "source", "src", "fbclid", "gclid", "msclkid", "mc_cid", "mc_eid", "_ga", "yclid", "igshid", "trk", "trackingid")

STOPWORDS = (
    "a", "an", "and", "the", "of", "for", "in", "on", "to", "with", "or", "is", "are", "as", "at", "by",
    "we", "you", "our", "your", "this", "that", "from", "into", "etc", "modern", "strong", "good", "new",
    "developer", "engineer", "development", "engineering", "experience", "skills", "work", "team", "role",
    "position", "job", "jobs", "using", "based", "e", "g", "i", "ie", "via", "all", "any",
)

#: Addresses that no one hires through.
SYSTEM_MAILBOXES = (
    "noreply", "no-reply", "donotreply", "do-not-reply", "gdpr", "privacy", "dpo", "unsubscribe", "webmaster", "support", "podpora", "helpdesk",
    "abuse", "postmaster", "newsletter", "press", "marketing", "sales", "obchod", "fakturace", "faktury", "invoice", "billing", "ucetni",
)
BOARD_DOMAINS = (
    "jobs.cz", "prace.cz", "lmc.eu", "alma.career", "teamio.com", "jobstack.it", "startupjobs.cz", "cocuma.cz", "skilleto.cz",
    "nofluffjobs.com", "jooble.org", "hitprace.cz", "profesia.cz",
)
COVERED_BOARDS = ("jobs.cz", "prace.cz", "startupjobs.cz", "jobstack.it", "cocuma.cz", "skilleto.cz", "nofluffjobs.com", "jooble.org")
UNREADABLE_HOSTS = (
    "indeed.com", "glassdoor.com", "glassdoor.co.in", "glassdoor.cz", "linkedin.com", "google.com", "facebook.com", "youtube.com",
    "wikipedia.org", "reddit.com", "x.com", "twitter.com", "instagram.com", "duckduckgo.com",
)

#: Boards in the order of the source enumeration, which sorting follows.
SOURCES = ("STARTUPJOBS", "JOBSTACK", "COCUMA", "SKILLETO", "NOFLUFFJOBS", "JOBSCZ", "JOOBLE", "GLASSDOOR", "ATS", "WEB")
STATUSES = ("PENDING", "APPLIED", "REJECTED", "INTERVIEW", "OFFER", "FAILED", "APPLYING", "NEEDS_MANUAL", "WAITING_FOR_USER")
#: Statuses whose tab is hidden while it counts nothing.
HIDDEN_WHEN_EMPTY = ("APPLYING", "WAITING_FOR_USER", "NEEDS_MANUAL")
#: Statuses that do not stand in the way of applying again.
REOPENED = ("REJECTED", "FAILED")

MONTHS = ("ledna", "února", "března", "dubna", "května", "června", "července", "srpna", "září", "října", "listopadu", "prosince")
FOREIGN_COUNTRIES = (
    "POL", "SVK", "HUN", "DEU", "AUT", "GBR", "USA", "NLD", "ESP", "FRA", "ITA", "ROU", "BGR", "UKR", "Poland", "Polska", "Germany", "Slovakia", "Hungary",
    "Austria", "United Kingdom", "United States", "Netherlands", "Spain", "France", "Italy", "Romania", "Bulgaria", "Ukraine",
)
COUNTRY_WORDS = r"(?iu)czech|česk|czechia|(^|[^a-z0-9_])cz([^a-z0-9_]|$)"
OPEN_REGIONS = r"(?iu)(^|[^a-z0-9_])(emea|europe|eu|cee|global|worldwide|anywhere|international|multiple locations)([^a-z0-9_]|$)"
REMOTE_ALONE = r"(?iu)^[\s,;()-]*remote[\s,;()-]*$"

#: Shares of the score and the values of its parts.
WEIGHTS = {"title": 0.35, "keywords": 0.25, "location": 0.15, "seniority": 0.1, "recency": 0.1, "salary": 0.05}
THRESHOLD = 0.3
PROFILE_SHARE = 0.15

#: How much a signal says about a job.
STATUS_WEIGHTS = {"APPLIED": 1.5, "INTERVIEW": 2.0, "OFFER": 2.0, "REJECTED": 1.0, "PENDING": 0.7, "APPLYING": 0.7, "NEEDS_MANUAL": 0.7, "FAILED": 0.5}
DISMISSED_WEIGHT, FAVOURITE_WEIGHT, JUDGED_WEIGHT = 1.5, 1.0, 0.5

#: The ranker's features, in the order of its inputs.
FEATURES = (
    "deterministic", "title", "keywords", "location", "seniority", "recency", "salary", "profileSkills", "profileTitle",
    "remote", "otherCity", "salaryListed", "descriptionLength", "embedding",
)

#: Fixed values of message checks and message shaping. Patterns are read without regard to case, unless said otherwise.
BANNED_PHRASES = (
    r"rád bych se uch[aá]zel",
    r"t[ií]mto se uch[aá]z[ií]m",
    r"t[ií]mto se hl[aá]s[ií]m",
    r"dovoluji si",
    r"v p[rř][ií]loze zas[ií]l[aá]m",
    r"bohat[ée] zku[sš]enosti",
    r"t[ěe][sš][ií]m se na",
    r"\bi am writing to\b",
    r"\bi would like to (apply|express)\b",
    r"\b(great|perfect) fit\b",
    r"\bi believe\b",
    r"\bi look forward\b",
    r"\bopportunity\b",
    r"\bstrong background\b",
    r"\bproven\b",
    r"\btrack record\b",
    r"\bskill ?set\b",
    r"\bexcited\b",
    r"nadšen[ýáéí]|nadšení",
    r"vášn|vášeň",
    r"přesvědčen",
    r"prospěšn",
    r"inovativn",
    r"unikátn",
    r"výzv[ao]u?\b",
    r"synergi",
    r"mindset",
    r"šikovn",
    r"skvěl",
    r"dynamick",
    r"ideáln[ií] kandidát",
    r"rád bych se podílel",
    r"mohl bych přispět",
    r"jsem si jist",
    r"cenn[ýé]m? aktiv",
    r"\bi am (excited|thrilled|passionate)\b",
    r"\bpassion(ate)?\b",
    r"\bleverage\b",
    r"\bsynerg",
    r"\bideal candidate\b",
    r"\bvaluable asset\b",
    r"\bi am confident\b",
    r"\bcutting[- ]edge\b",
    r"\binnovative\b",
    r"\bdynamic\b",
)
GREETING_LINE = r"^(dobr[ýyéá] (den|r[áa]no|ve[čc]er|odpoledne)|ahoj|zdrav[íi]m( v[áa]s)?|v[áa][žz]en[ýíé].{0,40}|hello|hi|dear .{0,40}|good (morning|afternoon|evening))[,!.]?$"
#: Closings that may stay above a signature, and those that become a relaxed one.
KEPT_CLOSING = r"^(s (pozdravem|úctou|přáním hezkého dne)|best regards|kind regards|regards|sincerely|yours sincerely)[,.]?$"
FORMAL_CLOSING = r"^(s (pozdravem|úctou|přáním (hezkého|pěkného) dne)|best regards|kind regards|warm regards|regards|sincerely|yours sincerely|yours faithfully)[,.]?$"
GREETINGS = {True: "Dobrý den,", False: "Hi,"}
CLOSINGS = {True: "Díky,", False: "Thanks,"}
#: Sentences that speak of experience, where they part into clauses, and clauses that only wish.
EXPERIENCE = (
    r"(zkušenost|praxi|praxe|pracoval|pracuji|mám za sebou|dělám|dělal|umím|znám|ovládám|používám|používal|využíval|využívám|vyvíjel|vyvíjím|vyvinul|postavil|stavím|stavěl|vytvořil|tvořil"
    r"|navrhl|navrhoval|implementoval|spolupracoval|podílel|vedl|řídil|věnuji|věnoval|\d+\s*(let|rok)|(let|rok)[yůu]?\b.*prax|experience|worked|working|i know|i use|i used|familiar|proficient|skilled"
    r"|i built|i develop|i have been|i led|i designed|i implemented|i delivered|i shipped|contributed|years)"
)
CLAUSE_BREAK = r"[,;]|\s+a\s+(?=r[áa]d|cht[ěe]l|chci|zaj[ií]m)|\s+and\s+(?=i(?:'d| would| want| am interested)|which)"
WISH = r"(r[áa]d(a)? bych|cht[ěe]l(a)? bych|chci|zaj[ií]m[áa] m[ěe]|zaj[ií]malo by|nau[čc]il|roz[sš][ií][rř]il|posunout|would like|want to|interested in|learn|keen to|looking to|hope to)"
#: Names of things, by case; words that look like such names and are none.
NAME_TOKEN = r"\b[A-Z][A-Za-z0-9+#]*(?:\.[A-Za-z]+)?\b|\.NET\b"
CAPITALISED_WORD = "^[A-ZÁČĎÉĚÍŇÓŘŠŤÚŮÝŽ][a-záčďéěíňóřšťúůýž]+$"
NAME_STOPWORDS = ("dobrý", "den", "hello", "dear", "s", "best", "kind", "regards", "cv", "ai", "it")
STEM_LENGTH = 5
COMMON_STEMS = (
    "pozic", "praci", "prace", "firma", "firmy", "firme", "vyvoj", "zkuse", "proje", "aplik", "softw", "techn", "nabid", "spole", "zivot", "pracu", "praxe", "praxi", "zajim",
    "roky", "rokyp", "tymu", "tymem", "nastr", "reseni", "resen", "pozad", "znalo", "dovedn", "doved", "kodu", "kod", "vyvoja", "vyvij", "pracov", "work", "exper", "posit", "compa",
    "team", "devel", "skill", "years", "role", "job", "appli", "build", "using", "with", "tools", "produ", "servi",
)
YEARS_CLAIM = (
    r"(?<![\p{L}\d])(\d{1,2}|jeden|jednoho|dva|dvou|tři|tří|čtyři|čtyř|pět|pěti|šest|šesti|sedm|sedmi|osm|osmi|devět|devíti|deset|deseti|one|two|three|four|five|six|seven|eight|nine|ten)"
    r"\s*(\+|a více|or more)?\s*-?(let|roky|rok|roků|years?)(?:[ouáéý]\p{L}*)?"
)
#: Numbers by the first three letters of the folded word.
NUMBER_STEMS = {
    "jed": "1", "dva": "2", "dvo": "2", "tri": "3", "cty": "4", "pet": "5", "ses": "6", "sed": "7", "osm": "8", "dev": "9", "des": "10",
    "one": "1", "two": "2", "thr": "3", "fou": "4", "fiv": "5", "six": "6", "sev": "7", "eig": "8", "nin": "9", "ten": "10",
}

#: Names of countries in forms, folded; the first of each is the one that is written out.
COUNTRIES = (
    ("CZ", ("ceska republika", "cesko", "czech republic", "czechia", "czech", "cz")),
    ("SK", ("slovensko", "slovenska republika", "slovakia", "slovak republic", "sk")),
    ("PL", ("polsko", "poland", "polska", "pl")),
    ("DE", ("nemecko", "germany", "deutschland", "de")),
    ("AT", ("rakousko", "austria", "osterreich", "at")),
    ("GB", ("velka britanie", "spojene kralovstvi", "united kingdom", "great britain", "uk", "gb")),
    ("US", ("spojene staty", "united states", "usa", "us")),
    ("NL", ("nizozemsko", "netherlands", "nederland", "nl")),
)
#: Labels that ask for a personal site.
PERSONAL_SITE = r"\b(web|website|webova|webove|stranka|stranky|site|homepage|portfolio|blog)\b"
