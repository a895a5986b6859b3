"""What a search query asks for: known intents by word or alias, else the query's own words."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Intent:
    category: str
    included_titles: list[str] = field(default_factory=list)
    excluded_titles: list[str] = field(default_factory=list)
    canonical_text: str = ""
    scraping_keyword: str = ""


#: The known intents.
INTENTS = {
    "react": Intent(
        "Frontend",
        ["React developer", "React frontend", "Frontend developer", "UI developer", "JavaScript developer", "TypeScript developer", "Next.js developer"],
        ["Backend", "Fullstack", "DevOps", "QA", "iOS", "Android", "Mobile", "Data engineer", "Java developer", "PHP developer", ".NET developer"],
        "React.js frontend developer, JavaScript TypeScript HTML CSS, React hooks Redux Context API, Next.js single-page applications, UI component libraries, responsive design, web interfaces, REST API integration, cross-browser compatibility, modern frontend tooling (Vite Webpack).",
        "React",
    ),
    "vue": Intent(
        "Frontend",
        ["Vue developer", "Vue.js developer", "Nuxt developer", "Frontend developer", "UI developer", "JavaScript developer"],
        ["Backend", "Fullstack", "DevOps", "QA", "iOS", "Android", "Mobile", "Data engineer"],
        "Vue.js frontend developer, Vue 3 Composition API Vuex Pinia, Nuxt.js, JavaScript TypeScript, HTML CSS, UI components, responsive design, web application development.",
        "Vue",
    ),
    "angular": Intent(
        "Frontend",
        ["Angular developer", "Frontend developer", "UI developer", "TypeScript developer"],
        ["Backend", "Fullstack", "DevOps", "QA", "iOS", "Android", "Mobile", "Data engineer"],
        "Angular frontend developer, Angular 17+ TypeScript RxJS NgRx, HTML CSS component architecture, single-page applications, web UI development.",
        "Angular",
    ),
    "frontend": Intent(
        "Frontend",
        ["Frontend developer", "UI developer", "React developer", "Vue developer", "Angular developer", "JavaScript developer", "TypeScript developer"],
        ["Backend", "Fullstack", "DevOps", "QA", "iOS", "Android", "Mobile", "Data engineer", "Java developer", "PHP developer", ".NET developer"],
        "Frontend web developer, React Vue Angular HTML CSS JavaScript TypeScript, UI/UX implementation, responsive design, web interfaces, component libraries, cross-browser compatibility, modern tooling.",
        "frontend",
    ),
    "backend": Intent(
        "Backend",
        ["Backend developer", "Server-side developer", "Node.js developer", "Python developer", "API developer", "Software engineer", "Java developer"],
        ["Frontend", "UI developer", "Mobile", "iOS", "Android", "DevOps only", "QA only", "Design"],
        "Backend software engineer, server-side development REST APIs GraphQL, Node.js Python Java Go, PostgreSQL MySQL MongoDB Redis, microservices, cloud AWS GCP Azure, system design, scalability, authentication.",
        "backend",
    ),
    "node": Intent(
        "Backend",
        ["Node.js developer", "Backend developer", "JavaScript developer", "TypeScript developer", "Fullstack developer"],
        ["Frontend only", "iOS", "Android", "DevOps only", "QA only", "Java pure backend"],
        "Node.js backend developer, Express Fastify NestJS, REST APIs GraphQL, TypeScript, PostgreSQL MongoDB Redis, microservices, cloud AWS GCP.",
        "node.js",
    ),
    "python": Intent(
        "Backend",
        ["Python developer", "Backend developer", "Software engineer", "Django developer", "FastAPI developer"],
        ["Frontend only", "iOS", "Android", "DevOps only", "QA only"],
        "Python backend developer, Django FastAPI Flask REST APIs, PostgreSQL Redis, cloud AWS, microservices, data processing, scripting automation.",
        "python",
    ),
    "fullstack": Intent(
        "Fullstack",
        ["Fullstack developer", "Full-stack developer", "Frontend developer", "Backend developer", "Software engineer", "React developer", "Node.js developer"],
        ["DevOps only", "QA only", "iOS", "Android", "Data engineer only", "Design only"],
        "Fullstack developer, React Vue Angular frontend plus Node.js Python backend, REST APIs GraphQL, PostgreSQL, TypeScript, cloud deployment, end-to-end feature development.",
        "fullstack",
    ),
    "devops": Intent(
        "DevOps",
        ["DevOps engineer", "Cloud engineer", "Platform engineer", "SRE", "Infrastructure engineer", "Kubernetes engineer"],
        ["Frontend", "Backend pure developer", "Mobile", "iOS", "Android", "QA only", "Data engineer"],
        "DevOps engineer, Kubernetes Docker CI/CD pipelines (GitLab GitHub Actions), AWS GCP Azure cloud infrastructure, Terraform monitoring Prometheus Grafana, reliability engineering, IaC.",
        "devops",
    ),
    "mobile": Intent(
        "Mobile",
        ["Mobile developer", "React Native developer", "Flutter developer", "iOS developer", "Android developer"],
        ["Backend only", "Frontend web only", "DevOps", "QA only", "Data engineer"],
        "Mobile developer, React Native Flutter iOS Android, cross-platform development, native modules, App Store Google Play, mobile UI, REST API integration, TypeScript Kotlin Swift.",
        "mobile",
    ),
    "ios": Intent(
        "Mobile",
        ["iOS developer", "Swift developer", "Mobile developer"],
        ["Android", "Flutter", "React Native", "Backend", "Frontend web", "DevOps", "QA"],
        "iOS developer Swift Objective-C Xcode UIKit SwiftUI, App Store distribution, Core Data networking ARKit Apple ecosystem.",
        "iOS",
    ),
    "android": Intent(
        "Mobile",
        ["Android developer", "Kotlin developer", "Mobile developer"],
        ["iOS", "Swift", "Flutter", "Backend only", "Frontend web", "DevOps", "QA"],
        "Android developer Kotlin Java Android Studio Google Play Jetpack Compose MVVM REST API integration mobile apps.",
        "android",
    ),
    "data": Intent(
        "Data",
        ["Data engineer", "Data analyst", "Data scientist", "ML engineer", "Machine learning engineer"],
        ["Frontend", "Backend pure", "Mobile", "iOS", "Android", "DevOps only", "QA only"],
        "Data engineer, ETL pipelines Apache Spark Airflow, Python SQL, data warehouses BigQuery Snowflake, machine learning MLOps, analytics dashboards, data modelling.",
        "data",
    ),
    "qa": Intent(
        "QA",
        ["QA engineer", "Test engineer", "SDET", "Automation engineer", "QA analyst"],
        ["Frontend", "Backend", "Mobile", "DevOps", "Data engineer"],
        "QA automation engineer, Selenium Playwright Cypress, test strategy, unit integration E2E testing, CI/CD test pipelines, bug tracking Jira, performance testing.",
        "QA",
    ),
}

#: Other words for the intents.
ALIASES = {
    "react.js": "react", "reactjs": "react", "nextjs": "react", "next.js": "react", "react native": "mobile", "reactnative": "mobile",
    "vue.js": "vue", "vuejs": "vue", "nuxt.js": "vue", "nuxtjs": "vue", "node.js": "node", "nodejs": "node", "full-stack": "fullstack",
    "fullstackdeveloper": "fullstack", "flutter": "mobile", "swift": "ios", "kotlin": "android", "datascience": "data", "data science": "data",
    "ml": "data", "machine learning": "data", "sre": "devops", "cloud": "devops", "infrastructure": "devops", "kubernetes": "devops",
    "k8s": "devops", "cypress": "qa", "playwright": "qa", "selenium": "qa", "testing": "qa", "automation": "qa",
}


def lookup_intent(query: str) -> Intent:
    """The intent of the whole query, else of its first known word, else the query as its own keyword."""
    lower = query.lower()
    words = [re.sub(r"[.\s-]+", "", lower.strip()), *filter(None, re.split(r"[^a-z0-9.#+]+", lower))]
    for word in words:
        known = INTENTS.get(ALIASES.get(word, word))
        if known:
            return known
    return Intent("Other", canonical_text=query, scraping_keyword=query)
