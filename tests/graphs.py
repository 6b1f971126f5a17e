"""A task made by chance, as the model's tables and as plain rows from which tests compute what they expect."""

import random

from fernweave.schemas import TABLES, conformed, empty

T = "job"
TREES = {"north": "acct00", "south": "acct01", "west": "acct02"}


def table(spark, name, rows):
    """rows: dictionaries with some of the table's columns."""
    kinds = dict(part.strip().split(" ", 1) for part in TABLES[name].split(", "))
    columns = list(rows[0])
    df = spark.createDataFrame([(T, *[r[c] for c in columns]) for r in rows], "task_id string, " + ", ".join(f"{c} {kinds[c]}" for c in columns))
    return conformed(df, name)


def made(spark, seed=17, n=36):
    """(frames, plain): every state of quality occurs; plain has the same rows by table."""
    rng = random.Random(seed)
    ids = [f"acct{k:02d}" for k in range(n)]
    nodes, profiles, metrics, posts = [], [], [], []
    for k, i in enumerate(ids):
        depth = 0 if k < len(TREES) else rng.choice([1, 1, 2, 2, 3, 6])
        status = "boundary" if depth == 6 else rng.choice(["complete", "complete", "failed", "filtered", "pending"])
        declared = rng.choice([None, 0, 4, 25, 1000])
        nodes.append({"account_id": i, "first_depth": depth, "is_l6_boundary": depth == 6, "expansion_status": status, "declared_following": declared, "collected_following": rng.choice([0, 3, 4, 20, 1000]), "termination_reason": rng.choice([None, "natural_end", "page_limit", "empty_pages"]), "network_indegree": rng.randrange(5), "timeline_status": "none"})
        if k % 7:
            profiles.append({"account_id": i, "username": f"{rng.choice(['Kite', 'otter', 'fern_', 'Marl'])}{k}", "description": rng.choice([None, "tea & maps", "OTTER fan"]), "followers_count": rng.choice([None, 12, 340, 5600, 78000]), "can_dm": rng.choice([None, True, False]), "verified": rng.choice([None, True, False]), "protected": rng.choice([None, True, False])})
        if k % 3 == 0:
            metrics.append({"account_id": i, "sample_count": 9, "scanned_count": 30 + k, "view_sample_count": rng.choice([0, 5]), "avg_like": rng.choice([None, 2.5, 80.0, float(k)])})
        posts += [{"account_id": i, "post_id": f"{i}-{j}", "kind": "original", "is_qualifying": rng.random() < 0.6} for j in range(rng.randrange(4))]
    pairs = rng.sample([(a, b) for a in ids[: n // 2] for b in ids if a != b], 90)
    depth = {x["account_id"]: x["first_depth"] for x in nodes}
    edges = [{"source_account_id": a, "target_account_id": b, "source_depth": depth[a], "target_depth": depth[b], "is_l6_boundary": depth[b] == 6} for a, b in pairs]
    seen = [{"tree_id": t, **{c: e[c] for c in ("source_account_id", "target_account_id", "source_depth", "target_depth")}, "is_collision": rng.random() < 0.3} for e in edges for t in rng.sample(sorted(TREES), rng.choice([1, 1, 2]))]
    found = [{"tree_id": x["tree_id"], "account_id": x["target_account_id"], "parent_account_id": x["source_account_id"], "depth": x["source_depth"] + 1, "is_collision": x["is_collision"]} for x in seen]
    plain = {
        "crawl_tasks": [{"status": "running", "current_depth": 1, "max_depth": 5, "timeline_enabled": True, "pages_produced": 31, "pages_processed": 24}],
        "root_trees": [{"tree_id": t, "seed_account_id": i} for t, i in TREES.items()],
        "account_nodes": nodes,
        "account_profiles": profiles,
        "account_metrics": metrics,
        "account_posts": posts,
        "follow_edges": edges,
        "follow_edge_observations": seen,
        "account_observations": found,
    }
    frames = {name: table(spark, name, plain[name]) if name in plain else empty(spark, name) for name in TABLES}
    return frames, plain


def listed(plain):
    """Each account with all that the listing tells of it, by id."""
    out = {}
    for node in plain["account_nodes"]:
        i = node["account_id"]
        seen = [x for x in plain["account_observations"] if x["account_id"] == i]
        profile = next((x for x in plain["account_profiles"] if x["account_id"] == i), dict.fromkeys(plain["account_profiles"][0]))
        metric = next((x for x in plain["account_metrics"] if x["account_id"] == i), None)
        row = profile | node | {"metric": metric, "avg_like": metric and metric["avg_like"]}
        row |= {"trees": sorted({x["tree_id"] for x in seen}), "collision_count": sum(x["is_collision"] for x in seen), "seed": i in TREES.values()}
        declared, collected = node["declared_following"], node["collected_following"]
        short, own = bool(declared) and collected < declared, node["termination_reason"] == "page_limit"
        flags = {"boundary_not_expanded": node["is_l6_boundary"], "expansion_failed": node["expansion_status"] == "failed", "expansion_filtered": node["expansion_status"] == "filtered"}
        flags |= {"scan_capped": short and own, "following_truncated": short and not own, "multiple_discovery_paths": row["collision_count"] > 0, "no_view_counts_in_sample": bool(metric) and metric["view_sample_count"] == 0}
        row["warnings"] = [name for name, on in flags.items() if on]
        row["coverage_ratio"] = round(collected / declared, 4) if declared else None
        row["incomplete"] = node["expansion_status"] in ("failed", "filtered") or bool(declared) and collected < declared
        out[i] = row
    return out
