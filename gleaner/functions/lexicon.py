"""Word lists, dictionaries and patterns that results depend on.

Fixed values: everything below must be as it is for results to come out right.
"""

from __future__ import annotations

# canonical skill: aliases, English list
SKILLS_EN = {
    "Python": ["python", "python3", "python 3"],
    "Java": ["java"],
    "JavaScript": ["javascript", "js", "ecmascript", "es6"],
    "TypeScript": ["typescript", "ts"],
    "C++": ["c++", "cpp"],
    "C#": ["c#", "c sharp", "csharp"],
    "Go": ["golang"],
    "Rust": ["rust"],
    "PHP": ["php"],
    "Ruby": ["ruby"],
    "Kotlin": ["kotlin"],
    "Swift": ["swift"],
    "SQL": ["sql"],
    "R": ["r"],
    "Bash": ["bash", "shell scripting", "shell"],
    "React": ["react", "reactjs", "react.js", "react js"],
    "Next.js": ["next.js", "nextjs", "next js"],
    "Vue.js": ["vue", "vue.js", "vuejs", "vue js"],
    "Angular": ["angular", "angularjs"],
    "Django": ["django"],
    "Flask": ["flask"],
    "FastAPI": ["fastapi"],
    "Spring Boot": ["spring boot", "springboot", "spring"],
    "Laravel": ["laravel"],
    "Node.js": ["node.js", "nodejs", "node js"],
    "TensorFlow": ["tensorflow", "tf"],
    "PyTorch": ["pytorch", "torch"],
    "scikit-learn": ["scikit-learn", "sklearn", "scikit learn"],
    "Pandas": ["pandas"],
    "NumPy": ["numpy"],
    "HTML/CSS": ["html/css", "html & css", "html5", "css3", "html", "css"],
    "MySQL": ["mysql"],
    "PostgreSQL": ["postgresql", "postgres"],
    "MongoDB": ["mongodb", "mongo"],
    "Redis": ["redis"],
    "SQLite": ["sqlite"],
    "SQL Server": ["sql server", "mssql", "microsoft sql server"],
    "Docker": ["docker"],
    "Kubernetes": ["kubernetes", "k8s"],
    "AWS": ["aws", "amazon web services"],
    "Google Cloud": ["google cloud", "gcp", "google cloud platform"],
    "Git": ["git", "github", "gitlab"],
    "Linux": ["linux", "ubuntu", "centos"],
    "NLP": ["nlp", "natural language processing"],
    "Machine Learning": ["machine learning", "ml"],
    "Deep Learning": ["deep learning", "neural networks"],
    "Data Analysis": ["data analysis", "data analytics"],
    "Data Visualization": ["data visualization", "data viz"],
    "Excel": ["excel", "microsoft excel", "ms excel"],
    "Microsoft Office": ["microsoft office", "ms office", "office suite"],
    "Figma": ["figma"],
    "REST APIs": ["rest", "rest api", "restful", "rest apis"],
    "Agile/Scrum": ["agile", "scrum", "kanban"],
    "Communication": ["communication", "communication skills"],
    "Teamwork": ["teamwork", "team collaboration"],
    "Leadership": ["leadership"],
    "Problem Solving": ["problem solving", "problem-solving", "analytical thinking"],
}

# the same, Indonesian list
SKILLS_ID = {
    "Python": ["python"],
    "JavaScript": ["javascript", "js"],
    "PHP": ["php"],
    "MySQL": ["mysql"],
    "Laravel": ["laravel"],
    "Django": ["django"],
    "Microsoft Office": [
        "microsoft office", "ms office", "ms word", "microsoft word", "ms excel", "microsoft excel", "ms power point",
        "microsoft power point", "ms powerpoint", "microsoft powerpoint",
    ],
    "Communication": ["komunikasi", "kemampuan komunikasi"],
    "Teamwork": ["kerja sama", "kerja tim", "kemampuan bekerja dalam tim", "bekerja dalam tim"],
    "Leadership": ["kepemimpinan", "memimpin tim"],
    "Problem Solving": ["pemecahan masalah", "penyelesaian masalah", "berpikir analitis"],
    "Data Analysis": ["analisis data", "analisa data"],
    "Machine Learning": ["pembelajaran mesin", "machine learning"],
    "NLP": ["pemrosesan bahasa alami", "nlp"],
    "Public Speaking": ["public speaking", "berbicara di depan umum"],
    "Time Management": ["manajemen waktu", "pengelolaan waktu"],
    "Attention to Detail": ["teliti", "ketelitian", "cermat"],
    "Adaptability": ["adaptif", "dapat beradaptasi", "mampu beradaptasi"],
}

# section: heading names, English and Indonesian
HEADINGS_EN = {
    "summary": ["SUMMARY", "PROFESSIONAL SUMMARY", "PROFILE", "OBJECTIVE", "ABOUT ME", "PERSONAL PROFILE", "OVERVIEW", "HIGHLIGHTS"],
    "experience": [
        "WORK EXPERIENCE", "PROFESSIONAL EXPERIENCE", "EXPERIENCE", "EMPLOYMENT HISTORY", "WORK HISTORY", "INTERNSHIP", "INTERNSHIPS",
        "VOLUNTEER EXPERIENCE", "ORGANIZATIONAL EXPERIENCE",
    ],
    "education": ["EDUCATION", "ACADEMIC BACKGROUND", "ACADEMIC HISTORY", "ACADEMIC QUALIFICATIONS", "EDUCATIONAL BACKGROUND"],
    "skills": [
        "SKILLS", "TECHNICAL SKILLS", "CORE SKILLS", "KEY SKILLS", "COMPETENCIES", "CORE COMPETENCIES", "EXPERTISE", "TECHNOLOGIES",
        "CERTIFICATIONS", "LANGUAGES",
    ],
}
HEADINGS_ID = {
    "summary": ["RINGKASAN", "RINGKASAN PROFESIONAL", "PROFIL", "PROFIL SINGKAT", "TENTANG SAYA", "TENTANG", "TUJUAN", "TUJUAN KARIER", "SASARAN"],
    "experience": [
        "PENGALAMAN KERJA", "PENGALAMAN PROFESIONAL", "PENGALAMAN", "RIWAYAT PEKERJAAN", "PENGALAMAN ORGANISASI", "PENGALAMAN MAGANG",
        "MAGANG", "PENGABDIAN",
    ],
    "education": ["PENDIDIKAN", "RIWAYAT PENDIDIKAN", "LATAR BELAKANG PENDIDIKAN", "PENDIDIKAN FORMAL"],
    "skills": ["KEAHLIAN", "KETERAMPILAN", "KEAHLIAN TEKNIS", "KETERAMPILAN TEKNIS", "KOMPETENSI", "TOOLS", "TEKNOLOGI", "SERTIFIKASI", "BAHASA"],
}
SECTIONS = ["summary", "experience", "education", "skills"]

DUTY_EN = [
    "responsible for", "duties included", "duties involve", "in charge of", "tasked with", "helped with", "assisted with", "assisted in",
    "worked on", "involved in", "participated in", "took part in", "support", "handle", "handling", "did", "made sure", "ensuring", "familiar with",
]
FUZZY_EN = ["various", "several", "multiple", "some", "many", "numerous", "misc", "miscellaneous", "etc"]
HEDGES_EN = ["tried to", "attempted to", "somewhat", "fairly", "quite", "somewhat involved"]
CLAIMS_EN = [
    "excellent", "expert", "proficient", "extensive experience", "strong background", "highly skilled", "vast experience",
    "proven track record", "results-driven", "detail-oriented", "hard worker", "hard-working", "team player", "fast learner",
    "good knowledge", "deep understanding", "passionate about",
]
DUTY_ID = [
    "bertanggung jawab", "bertanggung jawab atas", "tugas", "tugas saya", "menangani", "membantu", "membantu dalam", "mengerjakan",
    "terlibat dalam", "ikut serta", "berpartisipasi dalam", "mengikuti", "memastikan", "berpengalaman dalam", "mengetahui", "menangani hal",
]
FUZZY_ID = ["berbagai", "beberapa", "banyak", "sebagian", "macam-macam", "dll", "dan lain-lain", "antara lain"]
HEDGES_ID = ["mencoba untuk", "berusaha untuk", "agak", "cukup"]
CLAIMS_ID = [
    "sangat baik", "ahli", "menguasai", "berpengalaman luas", "lulusan terbaik", "pekerja keras", "mampu bekerja", "cepat belajar",
    "semangat", "berdedikasi", "jujur", "disiplin",
]
CUES = [*DUTY_EN, *FUZZY_EN, *HEDGES_EN, *DUTY_ID, *FUZZY_ID, *HEDGES_ID]
CLAIMS = [*CLAIMS_EN, *CLAIMS_ID]

OUTCOME_VERBS = [
    "reduced", "increased", "improved", "cut", "grew", "achieved", "delivered", "launched", "built", "developed", "designed", "implemented",
    "automated", "optimized", "mengurangi", "meningkatkan", "membangun", "mengembangkan", "merancang", "mengimplementasikan", "meraih",
    "mencapai", "memenangkan",
]
LEADERSHIP = [
    "led", "managed", "owned", "supervised", "coordinated", "mentored", "headed", "memimpin", "mengelola", "mengkoordinasi", "membimbing",
    "mengepalai",
]

EN_WORDS = (
    "the a an and or but with for from in on at to of by as is are was were be been this that these those it its their our my his her "
    "which while during after before about into over under than then also"
).split()
ID_WORDS = (
    "dan atau tetapi dengan untuk dari di ke pada dalam adalah ialah yaitu yang ini itu saya kami kita anda oleh sebagai kepada akan telah "
    "sedang tidak bisa dapat agar serta selama setelah sebelum hingga sampai antara semua setiap para juga masih sudah belum ada"
).split()
ID_PREFIXES = "meng meny mem men peng peny pem pen ber ter per di ke".split()
ID_SUFFIXES = "kan an i nya lah kah".split()
MIXED_SHARE = 0.34
SHORT_LINE_TOKENS = 8

STOP_WORDS = (
    "the a an and or of in on at to for with by is are was were be been this that it as from dan atau di ke dari yang untuk dengan pada adalah"
).split()
GENERIC_WORDS = [*STOP_WORDS, *"your you we these line consider suggest suggestion".split()]
COUNT_STOP_WORDS = (
    "the a an and or but with for from in on at to of by as is are was were be been this that these those it its their our my which while "
    "during after before about into over under than then also your you we line lines bullet consider dan atau tetapi dengan untuk dari di ke "
    "pada dalam adalah ialah yaitu yang ini itu saya kami kita anda oleh sebagai kepada akan telah sedang tidak bisa dapat agar serta selama "
    "setelah sebelum hingga sampai antara semua setiap juga masih sudah belum ada baris pertimbangkan buat bukti saran"
).split()

# patterns, in a syntax that Java's and RE2's engines share
WORD = r"[a-z0-9+#]+"
PERCENT = r"(?i)[0-9][ \t\n\r\f]?%|percent"
CURRENCY = r"(?i)[$€£Rp][ \t\n\r\f]?[0-9]|(?:[0-9][0-9.,]*)[ \t\n\r\f]*(?:usd|eur|juta|ribu|miliar|billion|million|thousand|k\b)"
CURRENCY_STRICT = r"(?i)(?:[$€£]|\bRp\.?)[ \t\n\r\f]?[0-9]|(?:[0-9][0-9.,]*)[ \t\n\r\f]*(?:usd|eur|juta|ribu|miliar|billion|million|thousand|k\b)"
MULTIPLIER = r"(?i)\b[0-9]+(?:\.[0-9]+)?[ \t\n\r\f]?(?:x|times)\b"
BIG_NUMBER = r"\b[0-9]{3,}\b"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
URL = r"(?i)https?://[^ \t\n\r\f\x0b]+|www\.[^ \t\n\r\f\x0b]+|linkedin\.com/[^ \t\n\r\f\x0b]+|github\.com/[^ \t\n\r\f\x0b]+"
PHONE = r"(?:\+[0-9]{1,3}[ \t\n\r\f.-]?)?(?:\([0-9]{2,4}\)[ \t\n\r\f.-]?)?[0-9]{3,4}[ \t\n\r\f.-]?[0-9]{3,4}(?:[ \t\n\r\f.-]?[0-9]{2,5})?"
NAME_WORD = r"[A-Z][a-z]+(?:['’\-][A-Z][a-z]+)?"
NAME_LINE = rf"^[ \t\r\f]*{NAME_WORD}(?:[ \t\r\f]+{NAME_WORD}){{1,3}}[ \t\r\f]*$"

MONTHS_EN = (
    "(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
)
MONTHS_ID = "(?:Jan(?:uari)?|Feb(?:ruari)?|Mar(?:et)?|Apr(?:il)?|Mei|Jun(?:i)?|Jul(?:i)?|Agu|Ags|Aug|Sep(?:t)?|Okt|Oktober|Nov|Des|Desember)"
PRESENT_EN = "(?:Present|Current|Now|Ongoing|Until now|To date)"
PRESENT_ID = "(?:Sekarang|Saat ini|Hingga saat ini|Sampai sekarang|Masih)"
DATE_RANGE = (
    rf"(?i){MONTHS_EN}\s+\d{{4}}\s*(?:-|–|—|to|until|s\.?d\.?)\s*(?:{MONTHS_EN}\s+\d{{4}}|{PRESENT_EN})"
    rf"|{MONTHS_ID}\s+\d{{4}}\s*(?:-|–|—|s\.?d\.?|hingga|sampai)\s*(?:{MONTHS_ID}\s+\d{{4}}|{PRESENT_ID})"
    rf"|\d{{1,2}}/\d{{4}}\s*(?:-|–|—)\s*(?:\d{{1,2}}/\d{{4}}|{PRESENT_EN}|{PRESENT_ID})"
    rf"|\b(?:19|20)\d{{2}}\s*(?:-|–|—|to|until|s\.?d\.?)\s*(?:(?:19|20)\d{{2}}|{PRESENT_EN}|{PRESENT_ID})\b"
)
PRESENT = rf"(?i){PRESENT_EN}|{PRESENT_ID}"
START_DATE = rf"(?i)(?:{MONTHS_EN}|{MONTHS_ID})?\s*\d{{1,2}}/\d{{4}}|\b(?:19|20)\d{{2}}\b|{MONTHS_EN}\s+\d{{4}}|{MONTHS_ID}\s+\d{{4}}"
TITLE_COMPANY = r"(?i)^([^,\-–|]{2,60}?)\s*(?:,|-|–|—|\||@|at|di)\s*([^,\-–|]{2,60})$"
DEGREE = (
    r"(?i)\b(Bachelor(?:'s)?(?: of [A-Za-z ]+)?|Master(?:'s)?(?: of [A-Za-z ]+)?|Ph\.?D\.?|Doctor(?:ate)?|B\.?S\.?c?\.?|M\.?S\.?c?\.?|B\.?A\.?|M\.?A\.?"
    r"|B\.?Eng|M\.?Eng|M\.?Tech|Sarjana|S1|S2|S3|D3|D4|Diploma|Magister|Doktor)\b(?:\s+(?:in|of)\s+([A-Za-z &]{2,40}))?"
)
GPA = r"(?i)\b(?:GPA|IPK)\s*[:\-]?\s*(\d(?:[.,]\d{1,2})?)\b(?:\s*/\s*(\d(?:[.,]\d)?))?"

EXEMPLARS = [
    "Reduced processing time by 30% for 5,000 users by automating the data pipeline.",
    "Led a team of 4 to deliver the project two weeks ahead of schedule.",
    "Built a REST API serving 10,000 daily requests with 99.9% uptime.",
    "Mengurangi waktu pemrosesan 30% untuk 5.000 pengguna dengan mengotomasi alur data.",
    "Memimpin tim beranggotakan 4 orang menyelesaikan proyek lebih cepat dua minggu.",
    "Membangun REST API yang melayani 10.000 permintaan harian dengan uptime 99,9%.",
]

UPLOAD_KINDS = {".pdf": "pdf", ".docx": "docx", ".txt": "text", ".md": "text"}
MAX_ZIP_ENTRIES = 2000
# end of the fixed values


def skill_rules() -> list[tuple[int, str, str]]:
    """(order, canonical, alias) of both lists, English first."""
    pairs = [(c, a) for skills in (SKILLS_EN, SKILLS_ID) for c, aliases in skills.items() for a in aliases]
    return [(i, c, a) for i, (c, a) in enumerate(pairs)]


def alias_lookup() -> dict[str, str]:
    """Lower-case alias or English canonical name -> canonical; the last rule wins."""
    out = {}
    for c, aliases in SKILLS_EN.items():
        out |= {a.lower(): c for a in aliases} | {c.lower(): c}
    for c, aliases in SKILLS_ID.items():
        out |= {a.lower(): c for a in aliases}
    return out


def heading_names() -> dict[str, str]:
    """Normalised heading -> section: English before Indonesian before English plurals."""
    out: dict[str, str] = {}
    for names, endings in ((HEADINGS_EN, [""]), (HEADINGS_ID, [""]), (HEADINGS_EN, ["s", "es"])):
        for section, headings in names.items():
            for h in headings:
                for e in endings:
                    out.setdefault(h.lower() + e, section)
    return out
