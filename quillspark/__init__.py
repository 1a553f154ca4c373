"""Conversation-log analytics on Spark: the public names."""

from .functions.redact import count_redactions, sanitize, sanitized
from .functions.issues import issues_of
from .functions.metrics import lexical, specificity
from .operators.batching import greedy_batches, strategy_of
from .operators.clustering import cluster_analysis, elbow, kmeans, labelled, silhouette
from .operators.compare import compare_patterns, history_summary
from .operators.issues import aggregate_individual, aggregate_minimal, apply_rules, merge_patterns, real_examples, rules_list
from .operators.prompts import by_day, in_range, of_project, on_date
from .operators.stats import describe, forecast, histogram, improvement, moving_average, outliers, projection, quantiles, trend
from .plans.pipeline import analyze, analyze_new
from .plans.provider import OfflineProvider, Provider, create_provider, first_available
from .plans.service import analyze_prompt, check_context, suggest_improvements
from .sources.logs import list_projects, parse_lines, read_logs
from .sources.store import cleanup_results, hits, list_history, load_history, misses, save_history
from .streaming.watch import watch

__all__ = [n for n in dir() if not n.startswith("_")]
