"""The engine's constants, as one frozen value that every operator takes as a default."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # fixed values: they must equal the reference semantics for equal results
    ripple_depth: int = 2
    ripple_decay: float = 0.7
    initial_activation: float = 1.0
    max_activation: float = 2.0
    user_preactivation: float = 0.5
    domain_threshold: float = 0.3
    top_k_seeds: int = 20
    top_k_paths: int = 10
    confidence_high: float = 0.7
    confidence_low: float = 0.3
    weight_delta: float = 0.01
    weight_min: float = 0.01
    weight_max: float = 2.0
    default_weight: float = 0.5
    max_pairs: int = 500
    global_ratio: float = 0.7
    personal_ratio: float = 0.3
    pool_threshold: int = 3
    pool_weight: float = 0.05
    overlap_threshold: float = 0.4
    alias_rate: float = 0.6
    alias_min_count: int = 5
    alias_margin: float = 0.2
    candidate_min: int = 5
    candidate_promote: int = 10
    candidate_expire_days: int = 30
    candidate_purge_days: int = 90
    candidate_weight: float = 0.05
    cold_start_queries: int = 20
    metrics_window: int = 1000
    explore_window: int = 100
    meta_weight: float = 0.05
    meta_delta: int = 2
    dormant_cycles: int = 100
    retired_cycles: int = 300
    conflict_alert: int = 10
    weight_alert: float = 1.8
    goal_low_conf: int = 5
    goal_density_ratio: float = 0.5
    goal_explore: float = 0.6
    goal_per_cycle: int = 3
    goal_decay_cycles: int = 10
    goal_decay: float = 0.8
    goal_expire: float = 0.05
    goal_pool: int = 1000
    hebbian_window_ms: int = 1000
    hebbian_rate: float = 0.01
    hebbian_decay: float = 0.001
    hebbian_max_pairs: int = 50
    discount: float = 0.7
    consistency: float = 0.8
    isa_depth: int = 20
    distance_depth: int = 5
    context_tokens: int = 2048
    query_chars: int = 500
    reliability: float = 0.7
    default_domain: str = "常识"
    unclassified: str = "未分类"


CONFIG = Config()
