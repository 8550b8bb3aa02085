"""The company registry: which boards to read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Boards known to answer, as system, slug and display name.
BOARDS = [
    ("smartrecruiters", "visa", "Visa"),
    ("smartrecruiters", "mcdonalds", "McDonald's"),
    ("smartrecruiters", "adidas", "Adidas"),
    ("smartrecruiters", "ikea", "IKEA"),
    ("smartrecruiters", "spotify", "Spotify"),
    ("smartrecruiters", "bosch", "Bosch"),
    ("smartrecruiters", "sephora", "Sephora"),
    ("smartrecruiters", "linkedin", "LinkedIn"),
    ("smartrecruiters", "equinix", "Equinix"),
    ("smartrecruiters", "informatica", "Informatica"),
    ("smartrecruiters", "squareenix", "Square Enix"),
    ("smartrecruiters", "ubisoft", "Ubisoft"),
    ("greenhouse", "xai", "xAI"),
    ("greenhouse", "spacex", "SpaceX"),
    ("greenhouse", "neuralink", "Neuralink"),
    ("greenhouse", "waymo", "Waymo"),
    ("greenhouse", "nuro", "Nuro"),
    ("greenhouse", "lucidmotors", "Lucid Motors"),
    ("greenhouse", "stripe", "Stripe"),
    ("greenhouse", "airbnb", "Airbnb"),
    ("greenhouse", "dropbox", "Dropbox"),
    ("greenhouse", "pinterest", "Pinterest"),
    ("greenhouse", "lyft", "Lyft"),
    ("greenhouse", "instacart", "Instacart"),
    ("greenhouse", "robinhood", "Robinhood"),
    ("greenhouse", "coinbase", "Coinbase"),
    ("greenhouse", "block", "Block"),
    ("greenhouse", "twilio", "Twilio"),
    ("greenhouse", "datadog", "Datadog"),
    ("greenhouse", "mongodb", "MongoDB"),
    ("greenhouse", "elastic", "Elastic"),
    ("greenhouse", "okta", "Okta"),
    ("greenhouse", "cloudflare", "Cloudflare"),
    ("greenhouse", "figma", "Figma"),
    ("greenhouse", "asana", "Asana"),
    ("greenhouse", "gitlab", "GitLab"),
    ("greenhouse", "vercel", "Vercel"),
    ("greenhouse", "netlify", "Netlify"),
    ("greenhouse", "postman", "Postman"),
    ("greenhouse", "amplitude", "Amplitude"),
    ("greenhouse", "mixpanel", "Mixpanel"),
    ("greenhouse", "databricks", "Databricks"),
    ("greenhouse", "deepmind", "DeepMind"),
    ("greenhouse", "inflectionai", "Inflection AI"),
    ("greenhouse", "jasper", "Jasper"),
    ("greenhouse", "descript", "Descript"),
    ("greenhouse", "figure", "Figure"),
    ("greenhouse", "agilityrobotics", "Agility Robotics"),
    ("greenhouse", "locusrobotics", "Locus Robotics"),
    ("greenhouse", "ginkgobioworks", "Ginkgo Bioworks"),
    ("greenhouse", "pathai", "PathAI"),
    ("greenhouse", "vizai", "Viz.ai"),
    ("greenhouse", "omadahealth", "Omada Health"),
    ("greenhouse", "paradigm", "Paradigm"),
    ("greenhouse", "magiceden", "Magic Eden"),
    ("greenhouse", "solanalabs", "Solana Labs"),
    ("greenhouse", "newrelic", "New Relic"),
    ("greenhouse", "circleci", "CircleCI"),
    ("greenhouse", "jfrog", "JFrog"),
    ("greenhouse", "pagerduty", "PagerDuty"),
    ("greenhouse", "launchdarkly", "LaunchDarkly"),
    ("greenhouse", "expel", "Expel"),
    ("greenhouse", "cybereason", "Cybereason"),
    ("greenhouse", "huntress", "Huntress"),
    ("greenhouse", "jetbrains", "JetBrains"),
    ("greenhouse", "orcasecurity", "Orca Security"),
    ("greenhouse", "stackblitz", "StackBlitz"),
    ("greenhouse", "buildkite", "Buildkite"),
    ("greenhouse", "anthropic", "Anthropic"),
    ("greenhouse", "scaleai", "Scale AI"),
    ("greenhouse", "brex", "Brex"),
    ("greenhouse", "mercury", "Mercury"),
    ("greenhouse", "gusto", "Gusto"),
    ("greenhouse", "carta", "Carta"),
    ("greenhouse", "benchling", "Benchling"),
    ("greenhouse", "webflow", "Webflow"),
    ("greenhouse", "airtable", "Airtable"),
    ("greenhouse", "retool", "Retool"),
    ("greenhouse", "temporal", "Temporal"),
    ("greenhouse", "planetscale", "PlanetScale"),
    ("greenhouse", "stabilityai", "Stability AI"),
    ("greenhouse", "intercom", "Intercom"),
    ("greenhouse", "salesloft", "Salesloft"),
    ("greenhouse", "apollo", "Apollo"),
    ("greenhouse", "zoominfo", "ZoomInfo"),
    ("greenhouse", "6sense", "6sense"),
    ("greenhouse", "cognism", "Cognism"),
    ("greenhouse", "canonical", "Canonical"),
    ("greenhouse", "singlestore", "SingleStore"),
    ("greenhouse", "neo4j", "Neo4j"),
    ("greenhouse", "cockroachlabs", "Cockroach Labs"),
    ("greenhouse", "redis", "Redis"),
    ("greenhouse", "fivetran", "Fivetran"),
    ("greenhouse", "fastly", "Fastly"),
    ("greenhouse", "starburst", "Starburst"),
    ("greenhouse", "sofi", "SoFi"),
    ("greenhouse", "chime", "Chime"),
    ("greenhouse", "affirm", "Affirm"),
    ("greenhouse", "billcom", "Bill.com"),
    ("greenhouse", "fireblocks", "Fireblocks"),
    ("greenhouse", "adyen", "Adyen"),
    ("greenhouse", "alchemy", "Alchemy"),
    ("greenhouse", "togetherai", "Together AI"),
    ("greenhouse", "labelbox", "Labelbox"),
    ("greenhouse", "arizeai", "Arize AI"),
    ("greenhouse", "snorkelai", "Snorkel AI"),
    ("greenhouse", "flexport", "Flexport"),
    ("greenhouse", "stockx", "StockX"),
    ("greenhouse", "faire", "Faire"),
    ("greenhouse", "opendoor", "Opendoor"),
    ("greenhouse", "oscarhealth", "Oscar Health"),
    ("greenhouse", "calm", "Calm"),
    ("greenhouse", "zscaler", "Zscaler"),
    ("greenhouse", "bugcrowd", "Bugcrowd"),
    ("greenhouse", "abnormalsecurity", "Abnormal Security"),
    ("greenhouse", "tanium", "Tanium"),
    ("lever", "zoox", "Zoox"),
    ("lever", "palantir", "Palantir"),
    ("lever", "color", "Color Health"),
    ("lever", "immutable", "Immutable"),
    ("lever", "swordhealth", "Sword Health"),
    ("lever", "sonatype", "Sonatype"),
    ("lever", "outreach", "Outreach"),
    ("lever", "people.ai", "People.ai"),
    ("lever", "clari", "Clari"),
    ("lever", "plaid", "Plaid"),
    ("lever", "anyscale", "Anyscale"),
    ("lever", "mistral", "Mistral AI"),
    ("lever", "ro", "Ro"),
    ("ashby", "openai", "OpenAI"),
    ("ashby", "notion", "Notion"),
    ("ashby", "snowflake", "Snowflake"),
    ("ashby", "clickup", "ClickUp"),
    ("ashby", "sentry", "Sentry"),
    ("ashby", "ramp", "Ramp"),
    ("ashby", "perplexity", "Perplexity"),
    ("ashby", "railway", "Railway"),
    ("ashby", "supabase", "Supabase"),
    ("ashby", "render", "Render"),
    ("ashby", "linear", "Linear"),
    ("ashby", "modal", "Modal"),
    ("ashby", "clerk", "Clerk"),
    ("ashby", "motherduck", "MotherDuck"),
    ("ashby", "pinecone", "Pinecone"),
    ("ashby", "weaviate", "Weaviate"),
    ("ashby", "langchain", "LangChain"),
    ("ashby", "cohere", "Cohere"),
    ("ashby", "runway", "Runway"),
    ("ashby", "synthesia", "Synthesia"),
    ("ashby", "pika", "Pika"),
    ("ashby", "elevenlabs", "ElevenLabs"),
    ("ashby", "character", "Character AI"),
    ("ashby", "insitro", "Insitro"),
    ("ashby", "compound", "Compound"),
    ("ashby", "phantom", "Phantom"),
    ("ashby", "matterlabs", "Matter Labs"),
    ("ashby", "cursor", "Cursor"),
    ("ashby", "replit", "Replit"),
    ("ashby", "qualified", "Qualified"),
    ("ashby", "demandbase", "Demandbase"),
    ("ashby", "confluent", "Confluent"),
    ("ashby", "chilipiper", "Chili Piper"),
    ("ashby", "influxdata", "InfluxData"),
    ("ashby", "airbyte", "Airbyte"),
    ("ashby", "prefect", "Prefect"),
    ("ashby", "astronomer", "Astronomer"),
    ("ashby", "roboflow", "Roboflow"),
    ("ashby", "poshmark", "Poshmark"),
    ("ashby", "lemonade", "Lemonade"),
    ("ashby", "whatnot", "Whatnot"),
    ("ashby", "hackerone", "HackerOne"),
    ("ashby", "vanta", "Vanta"),
    ("ashby", "drata", "Drata"),
]


def built_in_registry(spark: SparkSession) -> DataFrame:
    """The built-in boards as ``position, name, ats, slug``."""
    rows = [(position, name, ats, slug) for position, (ats, slug, name) in enumerate(BOARDS)]
    return spark.createDataFrame(rows, "position int, name string, ats string, slug string")


def registry_scope(registry: DataFrame, limit: int | None = None) -> DataFrame:
    """The boards to read: the first ``limit`` by position, less those without a system or slug.

    The slice comes first, so a skipped row still uses up its place. The name falls back to the slug.
    """
    if limit:
        registry = registry.orderBy("position").limit(limit)
    return registry.where("ats <> '' AND slug <> ''").select(
        F.coalesce("name", "slug").alias("name"), "ats", "slug"
    )


def registry_by_ats(registry: DataFrame) -> DataFrame:
    return registry.groupBy("ats").agg(F.count("*").alias("companies"))


def registry_gaps(registry: DataFrame, jobs: DataFrame) -> DataFrame:
    """Boards without a single posting.

    Postings are reduced to distinct companies first: the join sees one row per company, not a hot company's rows.
    """
    seen = jobs.select("ats", F.col("company").alias("slug")).distinct()
    return registry.join(seen, ["ats", "slug"], "left_anti")
