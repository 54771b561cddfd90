"""What several test modules share."""


def rows(df):
    """Rows of a DataFrame as a sorted list of tuples."""
    return sorted((tuple(r) for r in df.collect()), key=repr)


# (canonical, domain, aliases) of a lexicon whose aliases hold symbols, blanks and each other
SKILLS = (
    ("asp.net", "web", ("asp.net", "aspnet")),
    ("c#", "programming", ("c#",)),
    ("c++", "programming", ("c++",)),
    (".net", "programming", (".net", "dotnet", "dot net")),
    ("java", "programming", ("java",)),
    ("javascript", "programming", ("javascript", "js")),
    ("machine learning", "models", ("machine learning", "ml")),
    ("node.js", "programming", ("node.js", "nodejs", "node js")),
    ("nursing", "care", ("registered nurse", "rn", "r.n.")),
    ("pipelines", "delivery", ("ci/cd", "continuous integration")),
    ("python", "programming", ("python",)),
    ("spreadsheets", "office", ("excel", "ms excel")),
    ("sql", "databases", ("sql",)),
    ("sql server", "databases", ("sql server", "mssql")),
    ("stream engine", "data", ("spark", "apache spark")),
)
