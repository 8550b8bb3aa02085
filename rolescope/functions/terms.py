"""Canonical names of technologies and skills. Any function here takes another dictionary in place of the built-in ones."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import strip

# Technology spellings and their canonical form.
TECH = {
    "js": "javascript",
    "node": "nodejs",
    "node.js": "nodejs",
    "nodjs": "nodejs",
    "react.js": "react",
    "reactjs": "react",
    "vue.js": "vue",
    "vuejs": "vue",
    "angular.js": "angular",
    "angularjs": "angular",
    "next.js": "nextjs",
    "nuxt.js": "nuxtjs",
    "express.js": "express",
    "expressjs": "express",
    "nest.js": "nestjs",
    "nestjs": "nestjs",
    "typescript": "typescript",
    "ts": "typescript",
    "python3": "python",
    "py": "python",
    "django rest framework": "django",
    "drf": "django",
    "fast api": "fastapi",
    "flask": "flask",
    "pytorch": "pytorch",
    "torch": "pytorch",
    "tensor flow": "tensorflow",
    "tf": "tensorflow",
    "scikit-learn": "sklearn",
    "scikit learn": "sklearn",
    "sci-kit learn": "sklearn",
    "pandas": "pandas",
    "numpy": "numpy",
    "postgres": "postgresql",
    "psql": "postgresql",
    "mongo": "mongodb",
    "mongo db": "mongodb",
    "mysql": "mysql",
    "maria db": "mariadb",
    "mariadb": "mariadb",
    "redis": "redis",
    "elastic search": "elasticsearch",
    "elastic": "elasticsearch",
    "dynamodb": "dynamodb",
    "dynamo db": "dynamodb",
    "cassandra": "cassandra",
    "cockroach db": "cockroachdb",
    "cockroachdb": "cockroachdb",
    "amazon web services": "aws",
    "amazon aws": "aws",
    "google cloud platform": "gcp",
    "google cloud": "gcp",
    "azure": "azure",
    "microsoft azure": "azure",
    "k8s": "kubernetes",
    "kube": "kubernetes",
    "docker": "docker",
    "terraform": "terraform",
    "ansible": "ansible",
    "jenkins": "jenkins",
    "github actions": "github-actions",
    "gitlab ci": "gitlab-ci",
    "circle ci": "circleci",
    "circleci": "circleci",
    "apache spark": "spark",
    "pyspark": "spark",
    "apache kafka": "kafka",
    "apache airflow": "airflow",
    "apache flink": "flink",
    "snowflake": "snowflake",
    "databricks": "databricks",
    "dbt": "dbt",
    "data build tool": "dbt",
    "looker": "looker",
    "tableau": "tableau",
    "power bi": "powerbi",
    "powerbi": "powerbi",
    "golang": "go",
    "c++": "cpp",
    "c plus plus": "cpp",
    "c#": "csharp",
    "c sharp": "csharp",
    ".net": "dotnet",
    "dotnet": "dotnet",
    "rust": "rust",
    "scala": "scala",
    "kotlin": "kotlin",
    "swift": "swift",
    "objective-c": "objective-c",
    "ruby on rails": "rails",
    "ror": "rails",
    "machine learning": "ml",
    "deep learning": "deep-learning",
    "natural language processing": "nlp",
    "computer vision": "cv",
    "large language models": "llm",
    "llms": "llm",
    "generative ai": "genai",
    "gen ai": "genai",
    "openai": "openai",
    "langchain": "langchain",
    "hugging face": "huggingface",
    "huggingface": "huggingface",
}

# Skill spellings and their canonical form.
SKILLS = {
    "communication skills": "communication",
    "written communication": "communication",
    "verbal communication": "communication",
    "problem solving": "problem-solving",
    "problem-solving skills": "problem-solving",
    "critical thinking": "critical-thinking",
    "team work": "teamwork",
    "team player": "teamwork",
    "cross-functional collaboration": "cross-functional",
    "cross functional": "cross-functional",
    "leadership skills": "leadership",
    "project management": "project-management",
    "time management": "time-management",
    "attention to detail": "detail-oriented",
    "rest api": "rest-apis",
    "restful api": "rest-apis",
    "restful apis": "rest-apis",
    "api design": "api-design",
    "microservices architecture": "microservices",
    "distributed systems": "distributed-systems",
    "system design": "system-design",
    "data structures": "data-structures",
    "algorithms": "algorithms",
    "data structures and algorithms": "dsa",
    "dsa": "dsa",
    "object oriented programming": "oop",
    "object-oriented programming": "oop",
    "oop": "oop",
    "functional programming": "functional-programming",
    "test driven development": "tdd",
    "test-driven development": "tdd",
    "tdd": "tdd",
    "continuous integration": "ci-cd",
    "continuous deployment": "ci-cd",
    "ci/cd": "ci-cd",
    "cicd": "ci-cd",
    "agile methodology": "agile",
    "agile development": "agile",
    "scrum": "scrum",
    "kanban": "kanban",
    "machine learning": "machine-learning",
    "data analysis": "data-analysis",
    "data analytics": "data-analysis",
    "business intelligence": "bi",
    "bi": "bi",
    "data modeling": "data-modeling",
    "data engineering": "data-engineering",
    "data science": "data-science",
    "devops": "devops",
    "dev ops": "devops",
    "site reliability engineering": "sre",
    "sre": "sre",
    "security": "security",
    "cybersecurity": "cybersecurity",
    "cloud computing": "cloud",
    "cloud infrastructure": "cloud",
}


def no_terms() -> Column:
    """An empty list of strings."""
    return F.array().cast("array<string>")


def _literal_map(dictionary: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(dictionary.items())])


def normalize_term(term: Column, dictionary: dict[str, str]) -> Column:
    """Lower-cased, trimmed and looked up once; an unknown term is kept; NULL or '' gives ''."""
    cleaned = strip(F.lower(term))
    known = F.try_element_at(_literal_map(dictionary), cleaned)
    return F.coalesce(known, cleaned, F.lit(""))


def _normalize_list(terms: Column, dictionary: dict[str, str]) -> Column:
    mapped = F.transform(terms, lambda t: normalize_term(t, dictionary))
    distinct = F.array_distinct(F.filter(mapped, lambda t: t != ""))
    return F.coalesce(F.array_sort(distinct), no_terms())


def normalize_tech_stack(terms: Column, dictionary: dict[str, str] = TECH) -> Column:
    """Distinct canonical technologies in order; NULL gives an empty list."""
    return _normalize_list(terms, dictionary)


def normalize_skills(terms: Column, dictionary: dict[str, str] = SKILLS) -> Column:
    return _normalize_list(terms, dictionary)


def dictionary_table(spark: SparkSession) -> DataFrame:
    """Both dictionaries as rows ``kind, variant, canonical``, for users who keep their own copy."""
    rows = [("tech_stack", v, c) for v, c in TECH.items()] + [("skills", v, c) for v, c in SKILLS.items()]
    return spark.createDataFrame(rows, "kind string, variant string, canonical string")


def canonical_terms(dictionary: DataFrame) -> DataFrame:
    """The distinct canonical names of each kind, in order."""
    return dictionary.select("kind", F.col("canonical").alias("term")).distinct().orderBy("kind", "term")
