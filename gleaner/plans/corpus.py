"""A deterministic corpus in the domain's vocabulary, made of doc_id arithmetic.

The driver's documents hold almost no word of the dictionaries. This builds one
résumé-like text for each of them, with the document's whole text behind it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NL = "chr(10)"


def _pick(k: int, *texts: str) -> str:
    """The text that doc_id % k picks; the last stands for the rest."""
    quoted = [t if t.startswith(("('", "(CAST")) else "'" + t.replace("'", "''") + "'" for t in texts]
    return "CASE doc_id % " + str(k) + "".join(f" WHEN {i} THEN {t}" for i, t in enumerate(quoted[:-1])) + f" ELSE {quoted[-1]} END"


def _lines() -> list[str]:
    year = "(2008 + doc_id % 9)"
    return [
        _pick(5, "Siti Rahma", "Budi Santoso", "Anna Miller", "John O'Brien-Smith", "  CURRICULUM VITAE  "),
        "'user' || CAST(doc_id AS VARCHAR(20)) || '@mail.example.com | +62 812-3456-78' || CAST(10 + doc_id % 90 AS VARCHAR(20)) || ' | linkedin.com/in/u' || CAST(doc_id % 97 AS VARCHAR(20))",
        _pick(6, "SUMMARY", "Professional Summary:", "RINGKASAN", "Profile", "Objectives", "-"),
        _pick(
            7,
            "Excellent communication and proven track record in delivering results",
            "Detail-oriented analyst passionate about clean data pipelines",
            "Pekerja keras dan cepat belajar di lingkungan baru",
            "The engineer worked with the team on data for many of the products of this company",
            "Expert in Python with extensive experience in the design of REST APIs",
            "Saya adalah lulusan terbaik yang menguasai analisis data dan pemrosesan bahasa alami dengan cermat",
            "Fast learner, team player",
        ),
        "''",
        _pick(5, "SKILLS", "Technical Skills", "KEAHLIAN", "KETERAMPILAN TEKNIS:", "Notes"),
        _pick(
            8,
            "Python, SQL, JavaScript, React.js, Node.js, Docker, k8s",
            "Java, Spring Boot, MySQL, Git, Linux, C++",
            "r, R, python 3, Pandas, scikit-learn, TensorFlow, ML",
            "HTML/CSS, js, TypeScript, Vue.js, Figma",
            "Microsoft Excel, ms office, komunikasi, kerja tim, kepemimpinan",
            "golang, Rust, AWS, GCP, PostgreSQL, Redis",
            "C#, SQL Server, Agile, problem solving, leadership",
            "machine learning, deep learning, NLP, data analysis, data viz",
        ),
        _pick(4, "Reports and rest reports; communication skills, teamwork", "Public speaking, manajemen waktu, teliti", "PHP/Laravel & Django", "(Swift) Kotlin; bash"),
        _pick(6, "WORK EXPERIENCE", "PENGALAMAN KERJA", "Experience", "Employment History", "Internships", "Hobby list"),
        _pick(5, "Data Analyst, Acme Corp", "Software Engineer at Initech", "Staf Gudang di Tokoku", "Operations Coordinator", "Lead - Umbrella Group"),
        _pick(
            6,
            f"('Jan ' || CAST({year} AS VARCHAR(20)) || ' - Present')",
            f"('Feb ' || CAST({year} AS VARCHAR(20)) || ' - Mar ' || CAST({year} + 3 AS VARCHAR(20)))",
            f"('Feb ' || CAST({year} AS VARCHAR(20)) || ' - Sekarang')",
            f"(CAST({year} AS VARCHAR(20)) || ' - ' || CAST({year} + 2 AS VARCHAR(20)))",
            f"('03/' || CAST({year} AS VARCHAR(20)) || ' – 11/' || CAST({year} + 1 AS VARCHAR(20)))",
            f"('Barista, Kopi Kita: Agu ' || CAST({year} AS VARCHAR(20)) || ' sampai Des ' || CAST({year} + 1 AS VARCHAR(20)))",
        ),
        _pick(
            9,
            "- Responsible for various reports and handling customer data",
            "- Reduced processing time by 35% for 1200 users",
            "- Led a team of four analysts in the finance office",
            "- Bertanggung jawab atas berbagai tugas di kantor",
            "- Worked on several dashboards, helped with testing etc",
            "- Built a reporting pipeline used by the whole company",
            "- Meningkatkan penjualan sebesar 2x dalam 6 bulan dengan tim kecil",
            "- Tried to improve some of the quite old systems",
            "- Wrote notes and kept the archive in order",
        ),
        _pick(
            4,
            "- Managed the budget of $ 5000 for events",
            "- Assisted in preparing monthly dashboards for communication with clients",
            "- Membantu dalam mengerjakan laporan keuangan bulanan perusahaan",
            "- Saved Rp 15 juta and 3 times the effort",
        ),
        "CASE WHEN doc_id % 7 = 0 THEN '- Prepared monthly sales dashboards for regional managers' || chr(10) || '- Prepares monthly sales dashboard for the regional manager' ELSE '' END",
        _pick(5, "EDUCATION", "PENDIDIKAN", "Academic Background", "Education:", "Formal"),
        _pick(
            6,
            "Bachelor of Science in Computer Science, GPA: 3.65",
            "S1 Teknik Informatika, IPK 3,55",
            "Master's in Statistics",
            "Diploma of Accounting & Finance, GPA 3.5/4.0",
            "Sarjana Ekonomi",
            "Self taught",
        ),
        "coalesce(text, '')",
    ]


def corpus_sql(documents: str = "documents") -> str:
    """doc_id, text; every third document ends without a line break, every eleventh has CR LF line ends.

    The document's own text stands last, all of it.
    """
    body = f" || {NL} || ".join(_lines())
    return f"""SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN replace(body, chr(10), chr(13) || chr(10)) WHEN doc_id % 3 = 0 THEN body ELSE body || chr(10) END AS text
FROM (SELECT doc_id, {body} AS body FROM {documents}) AS b"""


def cv_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dealt by doc_id once: windows, aggregations and joins by document follow that without another exchange."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return spark.sql(corpus_sql("{documents}"), documents=documents).repartition("doc_id")


REQUIREMENTS = [
    (1, "Experience with Python and SQL data pipelines. Strong communication with clients; builds monthly dashboards."),
    (2, "Lead a team of analysts.\nPrepare monthly sales dashboards for managers. Excel required"),
    (3, "Menguasai analisis data dan laporan keuangan bulanan! Bekerja dalam tim kecil."),
    (4, "Design of REST APIs with Docker and k8s. Reduced processing time? Yes please;"),
    (5, "Java"),
]


def requirements(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REQUIREMENTS, "jd_id int, jd_text string")


def requirements_sql() -> str:
    rows = ", ".join(f"({i}, '{t.replace(chr(39), chr(39) * 2)}')" for i, t in REQUIREMENTS).replace("\n", "' || chr(10) || '")
    return f"SELECT * FROM (VALUES {rows}) AS v(jd_id, jd_text)"
