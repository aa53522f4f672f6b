"""Prompt and answer texts with named places, filled as Catalyst expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The instruction, the history's label and the item of each domain.
DOMAINS = {
    "movie": ("Given the user's watching history, select a film that is most likely to interest the user from the options.", "Watching history", "movie"),
    "music": ("Given the user's listening history, select an artist that the user is most likely to enjoy from the options.", "Listening history", "artist"),
}
# Texts whose wording a model was trained on or a reader knows.
TASK = """Below is an instruction that describes a task, paired with an input that provides further context. Write a response that appropriately completes the request.

Instruction: {instruction}

{label}: {{{history}}}.

Options: {{{options}}}.

Select a {item} from options A to T that the user is most likely to be interested in."""
ASKED = """User Query: {query}
User Preferences: {preferences}
"""
ALIGNMENT = {
    "triple": "Task: Convert the following factual triples into natural language knowledge suitable for movie recommendations.\n\n" + ASKED + """
Retrieved Triples:
{document}

Instructions:
1. Convert each triple into a natural, fluent sentence
2. Group related triples together
3. Maintain factual accuracy
4. Make the text easy to understand
5. Focus on information relevant to the user's query

Aligned Knowledge (natural language):""",
    "subgraph": "Task: Transform the following knowledge graph subgraph into natural language suitable for movie recommendations.\n\n" + ASKED + """
Retrieved Subgraph:
{document}

Instructions:
1. Extract key entities and their relationships
2. Describe connectivity patterns and relational paths
3. Summarize the semantic meaning of the subgraph
4. Organize information by relevance to the query
5. Use natural, flowing language
6. Highlight important connections between movies, actors, directors, etc.

Aligned Knowledge (natural language summary):""",
    "connected_graph": "Task: Transform the following connected knowledge graph into natural language for {kind} recommendations.\n\n" + ASKED + """
Connected Graph (with PageRank importance):
{document}

Instructions:
1. Emphasize highly important nodes (high PageRank scores)
2. Describe the connected paths between entities
3. Explain why these connections are relevant
4. Summarize the graph structure's semantic meaning
5. Focus on recommendation-relevant information
6. Use clear, natural language

Aligned Knowledge (natural language narrative):""",
    "direct": "Task: Generate {kind} recommendations based on the query without external knowledge.\n\n" + ASKED + """
Instructions:
Use your internal knowledge to provide recommendations.

Knowledge summary:""",
}
EXPLANATION = """Task: Analyze the knowledge and reason about what recommendations would be most suitable.

User Query: {query}
User Type: {user_type}
User Preferences: {preferences}

Retrieved Knowledge:
{knowledge}

Instructions:
1. Analyze the user's query to understand their intent
2. Examine the knowledge to identify relevant movies and patterns
3. Consider which movies best match the user's preferences
4. Consider diversity and variety in your analysis
5. Explain your analysis process step-by-step

Analysis:"""
RECOMMENDATION = """Task: Generate personalized {kind} recommendations based on analysis and knowledge.

User Query: {query}
User Type: {user_type}
User Preferences: {preferences}

{turns}
Knowledge from Knowledge Graph:
{knowledge}

Analysis:
{explanation}

Instructions:
1. Use the analysis to guide your recommendations
2. Generate 3-5 specific {item} recommendations
3. Explain WHY each {item} is recommended based on the analysis
4. Tailor to user preferences
5. Ensure diversity in recommendations
6. Be specific and actionable

Personalized {title} Recommendations:"""
TURNS = "Conversation History:\n{turns}\n"
SAID = """Let me analyze your request:
1. Query Analysis: You're asking about '{query}'
2. Available Knowledge: Found relevant information including {knowledge}
3. Matching Analysis: Based on {preferences}, I'll focus on movies that best align with your interests
4. Recommendation Strategy: I'll provide diverse options that match the themes and characteristics you're looking for"""
ADVICE = """Based on your request for '{query}', here are my personalized recommendations:

{body}

These recommendations are tailored for {user_type} lovers.
Let me know if you'd like more details about any of these options!"""
ADVICE_HEADING = "Recommended Movies:\n\n"
ADVICE_REASON, ADVICE_NO_REASON = "   Why: {fact}", "   This movie matches your interest in {preferences}"
ADVICE_NOTHING = """1. Based on the knowledge graph, I recommend exploring movies with similar themes
2. Consider films from the same directors or production companies
3. Look for movies in related genres"""
#: Characters kept of a query, of the knowledge in an explanation, in its prompt and in a recommendation's prompt.
MOST_QUERY, MOST_PREVIEW, MOST_EXPLAINED, MOST_RECOMMENDED = 100, 200, 800, 600
GENERAL_TYPE, GENERAL_PREFERENCES, GENERAL_USER = "general", "general preferences", "general user"

PLACE = re.compile(r"\{(\w+)\}")


def parts(template: str) -> list[tuple[bool, str]]:
    """(is a place, text) of a template; doubled braces are braces."""
    plain = template.replace("{{{", "\x02{").replace("}}}", "}\x03")
    out, at = [], 0
    for m in PLACE.finditer(plain):
        out += [(False, plain[at : m.start()]), (True, m.group(1))]
        at = m.end()
    out.append((False, plain[at:]))
    return [(place, t.replace("\x02", "{").replace("\x03", "}")) for place, t in out if t]


def filled(template: str, **values: Column | str) -> Column:
    """The template with its places filled; a null value makes the whole null."""
    column = lambda name: values[name] if isinstance(values[name], Column) else F.lit(values[name])
    return F.concat(*[column(t) if place else F.lit(t) for place, t in parts(template)])
