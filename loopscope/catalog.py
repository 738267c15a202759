"""Name -> query and name -> oracle SQL, gathered from the operator modules."""

from loopscope.operators import arms, attribution, contexts, files, inference, influence, injection_prompts, lists, loop, metrics, names, perturb, qa, qa_loop, regression, retrieval, studies
from loopscope.plans.registry import ORACLE, QUERIES
from loopscope.streaming import convergence, replays

__all__ = ["ORACLE", "QUERIES", "arms", "attribution", "contexts", "convergence", "files", "inference", "influence", "injection_prompts", "lists", "loop", "metrics", "names", "perturb", "qa", "qa_loop", "regression", "replays", "retrieval", "studies"]
