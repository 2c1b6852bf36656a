"""The derivations of ``scene_view`` in SQL, for the oracle queries."""

from __future__ import annotations

import re

# Each entry is the body of a common table expression; names used inside one are
# resolved and placed before it.
CTES = {
    "dets": """select event_id as det_seq, user_id // 15 as video_id,
        (epoch_us(ts) - 1704067200000000) // 21600000000 as frame_idx, event_type as run_id,
        user_id as local_obj_id, value / (value + 1e1) as score,
        cast((user_id * 5) % 40 + event_id % 4 as int) as y0,
        cast((user_id * 11) % 40 + (event_id * 3) % 4 as int) as x0,
        cast(8 + user_id % 12 as int) as bh, cast(8 + (user_id * 7) % 12 as int) as bw from events""",
    "best": """select * from (select *, row_number() over (partition by video_id, frame_idx, run_id, local_obj_id
        order by score desc, det_seq) as best_rn from dets) where best_rn = 1""",
    "spans": """select video_id, frame_idx, det_seq, run_id, v, u0, u1 from (
        select video_id, frame_idx, det_seq, run_id, unnest(range(y0, y0 + bh)) as v, x0 as u0, x0 + bw as u1 from dets)""",
    "best_spans": """select s.* from spans s join best b using (video_id, frame_idx, det_seq)""",
    "pixels": """select video_id, frame_idx, det_seq, v, unnest(range(u0, u1)) as u from spans""",
    "videos": """select distinct user_id // 15 as video_id from events""",
    "frames": """select video_id, f.frame_idx, video_id % 2 = 0 as is_metric, 1e-2 * f.frame_idx as tx
        from videos, (select unnest(range(120)) as frame_idx) f""",
    "lifted": """select video_id, frame_idx, det_seq, u, v,
        cast((1e0 / 5e2 * u + 0e0 * v + -32e0 / 5e2) * d + (0e0 - 1e-2 * frame_idx) as float)::double as x,
        cast((0e0 * u + 1e0 / 5e2 * v + -32e0 / 5e2) * d as float)::double as y, cast(d as float)::double as z
        from (select *, 5e0 + v / 64e0 * 5e-1 as d from pixels)
        where ((u * 31 + v * 17 + frame_idx) % 100) >= 50""",
    "moments": """select video_id, frame_idx, det_seq, n_points, is_metric,
        sx::double / (n_points * 1e6) as cx, sy::double / (n_points * 1e6) as cy, sz::double / (n_points * 1e6) as cz,
        sqrt((n_points * sxx - sx * sx)::double) / n_points / 1e6 as x_sigma,
        sqrt((n_points * syy - sy * sy)::double) / n_points / 1e6 as y_sigma,
        sqrt((n_points * szz - sz * sz)::double) / n_points / 1e6 as z_sigma,
        x_min, x_max, y_min, y_max, z_min, z_max
        from (select video_id, frame_idx, det_seq, count(*) as n_points, video_id % 2 = 0 as is_metric,
            sum(qx) as sx, sum(qy) as sy, sum(qz) as sz,
            sum(qx::hugeint * qx) as sxx, sum(qy::hugeint * qy) as syy, sum(qz::hugeint * qz) as szz,
            min(x) as x_min, max(x) as x_max, min(y) as y_min, max(y) as y_max, min(z) as z_min, max(z) as z_max
            from (select *, floor(x * 1e6)::bigint as qx, floor(y * 1e6)::bigint as qy, floor(z * 1e6)::bigint as qz
                  from lifted) group by video_id, frame_idx, det_seq)""",
    "obs": """select * from moments where n_points >= 30
        and (not is_metric or greatest(x_max - x_min, y_max - y_min, z_max - z_min) <= 3e1)""",
    "cells": """select video_id, frame_idx, det_seq, least(v // 4, 15) as row, least(u // 4, 15) as col,
        count(*) / 16e0 as iou from pixels group by all having count(*) / 16e0 > 5e-1""",
    "area": """select video_id, frame_idx, det_seq, sum(u1 - u0)::bigint as area,
        sum(v::bigint * (u1 - u0))::bigint as sv, sum((u0 + u1 - 1)::bigint * (u1 - u0))::bigint as su2
        from spans group by all""",
    "iou_pairs": """select p.video_id, p.frame_idx, a, b, inter, inter / (aa.area + ab.area - inter) as iou from (
        select l.video_id, l.frame_idx, l.det_seq as a, r.det_seq as b,
            sum(least(l.u1, r.u1) - greatest(l.u0, r.u0))::bigint as inter
        from best_spans l join best_spans r on l.video_id = r.video_id and l.frame_idx = r.frame_idx and l.v = r.v
            and l.det_seq < r.det_seq and l.run_id <> r.run_id and l.u0 < r.u1 and r.u0 < l.u1
        group by 1, 2, 3, 4) p
        join area aa on aa.det_seq = p.a join area ab on ab.det_seq = p.b""",
    "manifest": """select video_id, s.source_idx,
        [24e0, 25e0, 2997e-2, 3e1, 6e1, 5e0][1 + video_id % 6] as fps
        from videos, (select unnest(range(300)) as source_idx) s
        union all select (select max(video_id) + 1 from videos), unnest(range(300)), 0e0""",
    "points": """select 0::bigint as video_id, label::bigint as frame_idx, vec_id as object_id,
        embedding[1]::double * 2e1 as x, embedding[2]::double * 2e1 as y, embedding[3]::double * 2e1 as z
        from embeddings""",
    "qa": """select event_id,
        case when event_id % 4 < 3 then 'real_mc_' || (1 + event_id % 1371) else 'synth_mc_' || event_id end as id,
        case when event_id % 4 < 3 then 'real' else 'synthetic' end as split,
        case when event_id % 4 = 3 and event_id % 5 = 0 then 'no'
            else ['left', 'right', 'forward', 'backward'][1 + user_id % 4] end as answer,
        ['left', 'right', 'forward',
            case when event_id % 4 = 3 and event_id % 5 = 0 then 'no' else 'backward' end] as choice_texts,
        case (event_id + event_id % 3) % 8
            when 0 then 'Therefore, the final answer is: ' || substr('ABCD', 1 + (event_id // 8) % 4, 1)
            when 1 then substr('abcd', 1 + user_id % 4, 1)
            when 2 then substr('ABCD', 1 + user_id % 4, 1) || ') it moves'
            when 3 then 'I pick option: ' || substr('ABCD', 1 + user_id % 4, 1)
            when 4 then 'it is (' || substr('ABCD', 1 + user_id % 4, 1) || ')'
            when 5 then 'it is clearly moving right'
            when 6 then 'so D seems best' else 'unknown' end as response,
        'Which way does object ' || user_id || ' move?' as question,
        case event_id % 3 when 0 then 'https://media.example.org/data/videos_real/clip' || user_id || '.mp4'
            when 1 then 'https://cdn.example.org/x/videos_synthetic/s/clip' || user_id || '.mp4?dl=1'
            else 'https://elsewhere.example.org/clip' || user_id || '.mp4' end as video
        from events""",
}


def sql(body: str, **extra: str) -> str:
    """``body`` with the tables it names placed before it."""
    known = {**CTES, **extra}
    order: list[str] = []
    busy: list[str] = []

    def need(text: str) -> None:
        for name in known:
            if name not in order and name not in busy and re.search(rf"(\bfrom|\bjoin|,)\s+{name}\b", text):
                busy.append(name)
                need(known[name])
                order.append(name)

    need(body)
    if not order:
        return body
    word = "with recursive " if any(re.search(rf"\bfrom {n}\b", known[n]) for n in order) else "with "
    return word + ",\n".join(f"{n} as ({known[n]})" for n in order) + "\n" + body
