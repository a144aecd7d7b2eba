"""The same results in SQL over the given tables."""

# Tables as tables.py derives them.
SHARED = r"""
files as (
  select doc_id, concat('/src/', source, '/', doc_id // 100, '/doc_', doc_id % 100, '.', upper(lang)) as path,
    concat('doc_', doc_id % 100, '.', upper(lang)) as name, concat('.', lang) as extension,
    strlen(text) as file_size, timestamp '2024-01-01 00:00:00' + to_minutes(cast(doc_id as int)) as modified_at,
    sha256(text) as hash, 'sha256' as hash_type, source, lang
  from documents),
image_names as (
  select *, concat('doc_', doc_id % 100, '.',
    case lang when 'en' then 'JPG' when 'fr' then 'png' when 'de' then 'CR2' else 'txt' end) as image
  from files),
image_files as (
  select doc_id, concat('/src/', source, '/', doc_id // 100, '/', image) as path, image as name,
    concat('.', lower(split_part(image, '.', 2))) as extension, file_size, modified_at, hash, hash_type
  from image_names),
messy_files as (
  select doc_id, concat(case lang when 'fr' then '.' when 'de' then '~' else '' end, 'doc_', doc_id % 100,
    case when lang = 'es' then '.tmp' when source = 'src1' then '.part2.zip' else '.EN' end) as name, lang, source
  from files),
records as (
  select doc_id + 1 as id, hash, name as original_name, file_size, extension, modified_at as created_at,
    modified_at + interval 1 day as processed_at, path as source_path,
    case when toxic = 1 and quality = 1 then '' when toxic = 1 then null else concat('/library/2024/06/01/',
      case when doc_id // 100 = 0 then name
        else concat('doc_', doc_id % 100, '_', doc_id // 100, '.', split_part(name, '.', 2)) end) end as target_path,
    hash_type, quality, toxic
  from (select f.*, l.quality, l.toxic, row_number() over (partition by hash order by f.doc_id) as place
        from files f join labels l on f.doc_id = l.doc_id) where place = 1),
catalog as (
  select *, case when target_path is null or target_path = '' then source_path else target_path end as existing_path
  from records),
live as (select existing_path as path from catalog where quality = 1),
scan_catalog as (
  select doc_id + 1 as id, hash, case when toxic = 1 then concat('/old', path) else path end as existing_path
  from (select f.*, l.toxic, row_number() over (partition by hash order by f.doc_id) as place
        from image_files f join labels l on f.doc_id = l.doc_id) where place = 1),
file_events as (
  select event_id, concat('/src/', user_id, '.jpg') as path,
    case event_type when 'click' then 'CREATE' when 'error' then 'REMOVE' else 'WRITE' end as op, ts
  from events),
numbered as (select *, cast(regexp_extract(props, '[0-9]+') as int) // 4 as number from events),
log as (
  select date_trunc('second', ts) as ts, number, user_id, value,
    case number when 18 then 'WARN' when 21 then 'WARN' when 19 then 'INFO' when 24 then 'ERROR' else 'DEBUG' end as level
  from numbered),
all_samples as (
  select event_id, event_type,
    case number when 0 then 'file_copy_detail' when 1 then 'file_copy_total' when 2 then 'file_copy'
      when 3 then 'hash_calculation_detail' when 4 then 'hash_calculation_total' when 5 then 'hash_calculation'
      when 6 then 'database_insert' when 7 then 'database_query' when 8 then 'file_move_total' when 9 then 'file_move'
      when 10 then 'directory_creation' when 11 then 'permission_copy' when 12 then 'file_delete'
      when 13 then 'file_processing_total' when 14 then 'conflict_check' when 15 then 'file_info' when 16 then 'file_open'
      when 17 then 'path_generation' when 20 then 'duplicate_delete' when 21 then 'slow_query' when 22 then 'batch_insert'
      when 23 then 'copy_summary' end as operation,
    case event_type when 'click' then value when 'view' then value * 1000 when 'error' then value / 1000
      when 'purchase' then 60000 + value * 1000 else 3600000 + value * 1000 end as time_ms,
    case when number in (0, 3, 9, 23) then case event_type when 'click' then value / 1024 when 'view' then value
      when 'error' then value / 1048576 when 'purchase' then value * 1024 else value * 1048576 end end as size_mb,
    case when number in (0, 3, 23) then value end as speed_mbps,
    case when number in (8, 13) then concat('IMG_', user_id, '.jpg') end as filename
  from numbered),
samples as (select * from all_samples where operation is not null
  and operation not in ('duplicate_delete', 'slow_query', 'batch_insert', 'copy_summary')),
totals as (
  select operation, sum(time_ms) as total_ms, avg(time_ms) as avg_ms, count(*) as count from samples group by operation),
sessions as (
  select path, count(*) as events, min(ts) as first_ts, max(ts) as last_ts, max({'ts': ts, 'op': op}).op as last_op
  from (select *, sum(fresh) over (partition by path order by ts, event_id) as session
        from (select *, case when ts <= lag(ts) over (partition by path order by ts, event_id) + interval 30 minutes
                        then 0 else 1 end as fresh from file_events))
  group by path, session)
"""


def named(arriving: str, taken: str, most: int = 1000) -> str:
    """Final names of rows (key, path, name) in one folder, by trying suffixes up to ``most`` for each wanted name.

    The first by path gets the name itself if it is free; the others wait in order of their path's digest.
    """
    return rf"""
arriving as ({arriving}),
in_library as ({taken}),
taken_already as (select distinct name from in_library),
firsts as (
  select a.*, regexp_replace(a.name, '\.[^.]*$', '') as stem, regexp_extract(a.name, '\.[^.]*$') as ext,
    t.name is null and row_number() over (partition by a.name order by string_split(a.path, '/')) = 1 as owner
  from arriving a left join taken_already t on a.name = t.name),
turns as (
  select key, name, stem, ext, if(owner, 0, row_number() over (partition by name, owner order by md5(path), path)) as turn from firsts),
candidates as (
  select name, concat(stem, '_', n, ext) as candidate, n
  from (select distinct name, stem, ext from turns where turn > 0), range(1, {most}) as r(n)),
free as (
  select name, candidate, row_number() over (partition by name order by n) as turn from candidates
  where candidate not in (select name from taken_already union select name from arriving)),
named as (
  select t.key, case when t.turn = 0 then t.name else f.candidate end as final_name
  from turns t left join free f on t.name = f.name and t.turn = f.turn)"""


LIBRARY_NAMES = """
  select regexp_extract(existing_path, '[^/]*$') as name from catalog
  where regexp_replace(existing_path, '/[^/]*$', '') = '/library/2024/06/01'"""


def plan(incoming: str, live: str | None = "select path from live", reason: str = "null") -> str:
    """Ingest plan of the files ``incoming`` selects; those with a ``reason`` are not taken."""
    return (
        f"""
offered as (select *, {reason} as reason from ({incoming})),
incoming as (select * from offered where reason is null and hash is not null),
ordered as (select *, row_number() over (partition by hash order by string_split(path, '/')) as place,
  from incoming),
alive as ({live + " union " if live else ""} select path from incoming),
verdicts as (
  select o.hash, o.path as kept_path, o.name as kept_name, c.existing_path,
    case when c.hash is null then 'NEW' when c.existing_path in (select path from alive) then 'KNOWN'
      else '{"STALE" if live else "UNSURE"}' end as state
  from ordered o left join catalog c on o.hash = c.hash where o.place = 1),"""
        + named("select hash as key, kept_path as path, kept_name as name from verdicts where state in ('NEW', 'STALE')", LIBRARY_NAMES)
        + """,
decided as (
  select i.*, v.kept_path, v.existing_path as recorded, v.state,
    case when n.final_name is not null then concat('/library/2024/06/01/', n.final_name) end as kept_target,
    case when v.state in ('KNOWN', 'UNSURE') and i.path = v.existing_path then 'ALREADY_CATALOGUED'
      when v.state = 'KNOWN' then 'DELETE_DUPLICATE' when v.state = 'UNSURE' then 'SKIP_DUPLICATE'
      when i.path <> v.kept_path then 'DELETE_DUPLICATE' when v.state = 'STALE' then 'REPLACE_STALE' else 'MOVE' end as action
  from incoming i join verdicts v on i.hash = v.hash left join named n on i.hash = n.key),
plan as (
  select path, name, extension, file_size, modified_at, hash, hash_type, action,
    case when action in ('DELETE_DUPLICATE', 'ALREADY_CATALOGUED', 'SKIP_DUPLICATE')
        then if(state in ('KNOWN', 'UNSURE'), recorded, kept_target)
      when action = 'REPLACE_STALE' then recorded end as existing_path,
    case when action in ('MOVE', 'REPLACE_STALE') then kept_target end as target_path, cast(null as varchar) as reason
  from decided
  union all
  select path, name, extension, file_size, modified_at, hash, hash_type, if(reason is null, 'ERROR', 'SKIPPED'), null, null,
    coalesce(reason, 'not readable') from offered where reason is not null or hash is null),
added as (
  select (select max(id) from catalog) + row_number() over (order by hash) as id, hash, name as original_name, file_size,
    extension, timestamp '2024-06-01 12:00:00' as created_at, timestamp '2024-06-01 12:00:00' as processed_at,
    path as source_path, target_path, hash_type
  from plan where action in ('MOVE', 'REPLACE_STALE'))"""
    )


ALL = "select * exclude (doc_id, source, lang) from files"
INGEST = plan(ALL)
STREAM_INGEST = plan(ALL, live=None)
FILTERED = plan(
    "select * exclude (doc_id, source, lang, hash), if(doc_id % 50 <> 0, hash, null) as hash from files",
    reason="case when extension not in ('.en', '.fr') then 'extension' when file_size > 4096 then 'size' end",
)


def scan(duplicate: str) -> str:
    return f"""
incoming as (select * from image_files where extension in ('.jpg', '.png', '.cr2')),
plan as (
  select i.path, i.name, i.extension, i.file_size, i.modified_at, i.hash, i.hash_type,
    case when c.existing_path = i.path then 'ALREADY_CATALOGUED'
      when c.existing_path in (select path from incoming) or place > 1 then '{duplicate}'
      when c.hash is not null then 'REPLACE_STALE' else 'CATALOG' end as action,
    case when c.existing_path in (select path from incoming) then c.existing_path
      when place > 1 then kept_path else c.existing_path end as existing_path,
    case when place = 1 and (c.hash is null or c.existing_path not in (select path from incoming)) then i.path end as target_path,
    cast(null as varchar) as reason
  from (select *, row_number() over (partition by hash order by string_split(path, '/')) as place,
          first_value(path) over (partition by hash order by string_split(path, '/')) as kept_path from incoming) i
  left join scan_catalog c on i.hash = c.hash
  union all
  select path, name, extension, file_size, modified_at, hash, hash_type, 'SKIPPED', null, null, 'extension'
  from image_files where extension = '.txt')"""


def over(select: str, *ctes: str) -> str:
    return "with " + ",".join([SHARED, *ctes]) + "\n" + select


COLUMNS = "id, hash, original_name, file_size, extension, created_at, processed_at, source_path, target_path, hash_type"
FILE = "path, name, extension, file_size, modified_at, hash, hash_type"
PLAN = FILE + ", action, existing_path, target_path, reason"


def catalog_sql() -> dict[str, str]:
    """Catalog, filters, projections, joins and statistics."""
    kept = "action in ('MOVE', 'CATALOG', 'REPLACE_STALE')"
    out = {
        "filter_supported": f"select {FILE} from files where lang in ('en', 'fr')",
        "filter_images": f"select {FILE} from image_files where extension <> '.txt'",
        "filter_max_size": f"select {FILE} from files where file_size <= 1024",
        "filter_hidden": "select doc_id, name from messy_files where lang <> 'fr'",
        "filter_temp": "select doc_id, name from messy_files where lang not in ('de', 'es') and not (source = 'src1')",
        "filter_ready": f"select {FILE} from files where file_size between 1 and 4096",
        "file_by_hash": f"select {COLUMNS} from catalog where hash = (select max(hash) from catalog)",
        "large_files": f"select {COLUMNS} from catalog where file_size > 4096",
        "to_catalog_rows_ingest": """select hash, name as original_name, file_size, extension,
            timestamp '2024-06-01 12:00:00' as created_at, timestamp '2024-06-01 12:00:00' as processed_at,
            path as source_path, concat('/library/2024/06/01/', name) as target_path, hash_type from files""",
        "to_catalog_rows_scan": """select hash, name as original_name, file_size, extension, modified_at as created_at,
            timestamp '2024-06-01 12:00:00' as processed_at, path as source_path, path as target_path, hash_type from files""",
        "existing_path": "select id, existing_path from catalog",
        "match_catalog": f"""select {', '.join('f.' + c for c in FILE.split(', '))}, c.id as catalog_id, c.existing_path,
            c.id is not null as known from files f left join catalog c on f.hash = c.hash""",
        "known_files": f"select {FILE} from files where hash in (select hash from catalog)",
        "new_files": f"select {FILE} from files where hash not in (select hash from catalog)",
        "stale_records": "select id, hash, existing_path from catalog where existing_path not in (select path from live)",
        "delete_records": f"select {COLUMNS} from catalog where quality = 1",
        "deletion_report": """select f.hash, count(distinct c.id) as rows_affected,
            case when count(c.id) = 0 then 'no such record' end as warning
            from files f left join catalog c on f.hash = c.hash group by f.hash""",
        "taken_names": "select path, name from files where concat('/library/2024/06/01/', name) in (select existing_path from catalog)",
        "merge_catalog": f"select {COLUMNS} from catalog where quality = 1 union all select {COLUMNS} from catalog where quality = 0",
        "check_catalog": """select * from (
            select 'unique_hash' as "check", count(*) as violations
              from (select hash from files group by hash having count(*) > 1)
            union all select 'not_null_' || c, 0 from (select unnest(['id', 'hash', 'original_name', 'file_size', 'extension',
              'created_at', 'source_path', 'hash_type']) as c)
            union all select 'max_length_hash', count_if(length(hash) > 128) from files
            union all select 'max_length_original_name', count_if(length(name) > 500) from files
            union all select 'max_length_extension', count_if(length(extension) > 50) from files
            union all select 'max_length_hash_type', count_if(length(hash_type) > 20) from files)""",
        "total_files": "select count(*) as total_files from catalog",
        "total_size": "select cast(coalesce(sum(file_size), 0) as bigint) as total_size from catalog",
        "stats_by_extension": "select extension, count(*) as count, cast(sum(file_size) as bigint) as size from files group by extension",
        "extensions_ranked": "select extension, count(*) as count, cast(sum(file_size) as bigint) as size from files group by extension",
        "stats_by_size_tier": """select case when file_size < 1024 then 'small' when file_size <= 4096 then 'medium' else 'large' end
            as tier, count(*) as count, cast(sum(file_size) as bigint) as size from files group by 1""",
        "catalog_statistics": """select extension, grouping(extension) = 1 as total, count(*) as count,
            cast(sum(file_size) as bigint) as size from files group by rollup (extension)""",
        "files_by_extension": f"select {COLUMNS} from catalog where extension = '.en' order by processed_at desc, id limit 20",
        "largest_files": f"select {COLUMNS} from catalog order by file_size desc, id limit 10",
        "largest_files_per_extension": f"""select {COLUMNS}, rank from (select *,
            row_number() over (partition by extension order by file_size desc, id) as rank from catalog) where rank <= 3""",
        "dedup_keep_first": f"""select {FILE} from (select *, row_number() over (partition by hash
            order by string_split(path, '/')) as place from files) where place = 1""",
        "dedup_keep_last": """select doc_id as id, hash, path from (select *, row_number() over (partition by hash
            order by doc_id desc) as place from files) where place = 1""",
        "compact_catalog": """select doc_id as id, hash, path from files f
            where not exists (select 1 from files b where f.doc_id < b.doc_id and f.hash = b.hash)""",
        "duplicate_groups": f"""select {FILE}, kept_path, copies, path <> kept_path as is_duplicate from (select *,
            first_value(path) over (partition by hash order by string_split(path, '/')) as kept_path,
            count(*) over (partition by hash) as copies from files)""",
        "worker_load": """select count(*) as workers, cast(sum(load) as bigint) as total_load_ns,
            cast(sum(load) // count(*) as bigint) as avg_load_ns, cast(min(load) as bigint) as min_load_ns,
            cast(max(load) as bigint) as max_load_ns, cast(sum(load) // sum(n) as bigint) as avg_file_ns
            from (select user_id, sum(cast(round(value * 1000000) as bigint)) as load, count(*) as n from events group by 1)""",
        "throughput": """select files, bytes, seconds, round(files / seconds, 6) as files_per_second,
            round(bytes / seconds, 6) as bytes_per_second from (select count(*) as files, cast(sum(file_size) as bigint) as bytes,
            (epoch_us(max(modified_at)) - epoch_us(min(modified_at))) / 1e6 as seconds from files)""",
    }
    out = {name: over(sql) for name, sql in out.items()}
    out["resolve_name_conflicts"] = over(
        f"select f.path, f.name, n.final_name from files f join named n on f.path = n.key",
        named("select path as key, path, name from files", LIBRARY_NAMES),
    )
    out["crowded_names"] = over(
        "select f.path, n.final_name from files f join named n on f.path = n.key",
        named(
            "select path as key, path, 'IMG.jpg' as name from files",
            "select concat('IMG_', doc_id * 3, '.jpg') as name from documents where doc_id % 2 = 1", 30_000,
        ),
    )
    out["plan_ingest"] = over(f"select {PLAN} from plan", INGEST)
    out["plan_ingest_filtered"] = over(f"select {PLAN} from plan", FILTERED)
    out["write_action_plan"] = out["plan_ingest"]
    out["replace_stale"] = out["apply_plan"] = over(
        f"""select {COLUMNS} from catalog where hash not in (select hash from plan where action = 'REPLACE_STALE')
        union all select {COLUMNS} from added""",
        INGEST,
    )
    out["ingest_stream"] = over(f"select {COLUMNS} from catalog union all select {COLUMNS} from added", STREAM_INGEST)
    for name in ("append_catalog", "scheduled_ingest", "micro_batch_flush"):
        out[name] = out["ingest_stream"]
    out["file_inventory"] = out["new_file_stream"] = """select doc_id, '.txt' as extension, cast(strlen(text) + 1 as bigint) as file_size,
        sha256(concat(text, chr(10))) as hash, 'sha256' as hash_type from documents"""
    out["quarantine_failures"] = """select doc_id, '.txt' as extension, cast(strlen(text) + 1 as bigint) as file_size,
        cast(null as varchar) as hash, if(doc_id % 7 = 0, 'ERROR', 'RETRY') as action, 'not readable' as reason,
        cast(if(doc_id % 7 = 0, 3, 1) as int) as tries from documents where doc_id % 7 < 2"""
    out["catalog_index"] = over(
        """select doc_id as id, hash, name as original_name, file_size, extension, modified_at as created_at,
            modified_at as processed_at, path as source_path, path as target_path, hash_type
        from files f where not exists (select 1 from files b where f.doc_id < b.doc_id and f.hash = b.hash)
            and hash in (select hash from files join labels using (doc_id) where quality = 0)"""
    )
    out["stored_deletes"] = over(
        """select state, id, hash, original_name, file_size, extension, created_at, processed_at, source_path, target_path, hash_type
        from kept cross join (values ('segments'), ('folded'), ('found')) s(state)
        where state <> 'found' or hash in (select hash from bad)""",
        """bad as (select hash from files join labels using (doc_id) where quality = 0),
        kept as (
          select doc_id + if(doc_id % 7 = 0, 1000000000, 0) as id, hash, name as original_name, file_size, extension,
            modified_at as created_at, modified_at as processed_at, path as source_path, path as target_path, hash_type
          from files f where not exists (select 1 from files b where f.doc_id < b.doc_id and f.hash = b.hash)
            and (doc_id % 7 = 0 or hash not in (select hash from bad)))""",
    )
    out["read_catalog"] = over(f"select {COLUMNS} from catalog")
    out["write_library"] = over(
        "select target_path, hash, file_size, '2024' as year, '06' as month, '01' as day from plan"
        f" where {kept}", INGEST
    )
    out["running_totals"] = over(
        "select action, count(*) as files, cast(sum(file_size) as bigint) as bytes from plan group by action", INGEST
    )
    out["running_rates"] = over(
        """select action, files, bytes, first_at, last_at, elapsed_seconds, round(files / nullif(elapsed_seconds, 0), 9) as files_per_second,
          round(bytes / nullif(elapsed_seconds, 0), 6) as bytes_per_second
        from (select action, count(*) as files, cast(sum(file_size) as bigint) as bytes, min(modified_at) as first_at,
            max(modified_at) as last_at, (epoch_us(max(modified_at)) - epoch_us(min(modified_at))) / 1000000 as elapsed_seconds
          from plan group by action)""", INGEST
    )
    out["processing_stats"] = over(
        f"""select count(*) as processed_files, count_if({kept}) as moved_files,
        count_if(action = 'DELETE_DUPLICATE') as deleted_files,
        count_if(action in ('SKIPPED', 'SKIP_DUPLICATE', 'ALREADY_CATALOGUED')) as skipped_files, count_if(action = 'ERROR') as error_count,
        cast(sum(file_size) filter ({kept} or action = 'DELETE_DUPLICATE') as bigint) as total_size,
        cast(sum(file_size) filter ({kept}) as bigint) as moved_size from plan""",
        INGEST,
    )
    out["outcome_percentages"] = over(
        f"""select round(100.0 * count_if({kept}) / count(*), 1) as moved_percent,
        round(100.0 * count_if(action = 'DELETE_DUPLICATE') / count(*), 1) as duplicate_percent,
        round(100.0 * count_if(action = 'ERROR') / count(*), 1) as error_percent from plan""",
        INGEST,
    )
    out["average_size"] = over(
        f"""select cast(sum(file_size) filter ({kept} or action = 'DELETE_DUPLICATE') // count_if({kept}) as bigint) as avg_size_reported,
        cast(sum(file_size) filter ({kept}) // count_if({kept}) as bigint) as avg_size_moved from plan""",
        INGEST,
    )
    out["plan_scan"] = over(f"select {PLAN} from plan", scan("DELETE_DUPLICATE"))
    out["plan_scan_skip"] = over(f"select {PLAN} from plan", scan("SKIP_DUPLICATE"))
    out["scan_stats"] = over(
        """select count_if(action in ('CATALOG', 'REPLACE_STALE')) as processed,
        count_if(action in ('SKIPPED', 'SKIP_DUPLICATE', 'ALREADY_CATALOGUED')) as skipped, count_if(action = 'ERROR') as errors,
        count_if(action = 'DELETE_DUPLICATE') as deleted, count(*) as total from plan""",
        scan("SKIP_DUPLICATE"),
    )
    return out


def function_sql() -> dict[str, str]:
    """Scalar functions."""
    out = {
        "sha256_hex": "select doc_id, sha256(text) as value from documents",
        "md5_hex": "select doc_id, md5(text) as value from documents",
        "content_hash": "select doc_id, md5(text) as md5, sha256(text) as sha256, sha256(text) as default_hash from documents",
        "file_extension": "select path, concat('.', lang) as value from files",
        "normalize_extension": "select doc_id, concat('.', lang) as bare, concat('.', lang) as dotted from files",
        "base_name": "select path, name as value from files",
        "name_stem": "select path, concat('doc_', doc_id % 100) as value from files",
        "date_path": "select doc_id, strftime(modified_at, '%Y/%m/%d') as value from files",
        "join_path": "select doc_id, concat('/library/', strftime(modified_at, '%Y/%m/%d'), '/', name) as value from files",
        "suffixed_name": "select path, concat('doc_', doc_id % 100, '_', doc_id // 100, '.', upper(lang)) as value from files",
        "format_file_size": """select doc_id, case when size < 1024 then printf('%d B', size)
            when size < 1048576 then printf('%.1f KB', size / 1024) when size < 1073741824 then printf('%.1f MB', size / 1048576)
            when size < 1099511627776 then printf('%.1f GB', size / 1073741824)
            else printf('%.1f TB', size / 1099511627776) end as value
            from (select doc_id, file_size * (doc_id + 1) * if(lang = 'fr', file_size, 1) as size from files)""",
        "transfer_speed": """select event_id, round(case when value > 0 then user_id * 1000 / (value / 1000) / 1048576 end, 6) as value
            from events""",
        "hash_prefix": "select doc_id, concat(left(hash, 12), '...') as short, concat(left(hash, 16), '...') as longer, hash as whole from files",
        "duration_ms": "select event_id, round(time_ms, 6) as value from all_samples",
        "size_mb": """select event_id, case event_type when 'click' then value / 1024 when 'view' then value
            when 'error' then value / 1048576 when 'purchase' then value * 1024 else value * 1048576 end as value from events""",
        "round_to_second": "select event_id, cast(round(value) as bigint) as value from events",
        "skipped_file_name": "select ts, concat('/src/', user_id, '.jpg') as value from log where number = 18",
        "parse_log_line": """select ts, level, if(number = 24, 'unknown', 'worker.go') as caller_file,
            if(number = 24, null, cast(user_id as int)) as caller_line from log""",
        "log_level_rank": "select ts, level, case level when 'DEBUG' then 0 when 'INFO' then 1 when 'WARN' then 2 else 3 end as value from log",
    }
    return {name: over(sql) for name, sql in out.items()}


NAME = """case operation when 'file_copy_detail' then 'File copy details' when 'file_copy_total' then 'File copy, total time'
  when 'file_copy' then 'File copy' when 'hash_calculation_detail' then 'Hash calculation details'
  when 'hash_calculation_total' then 'Hash calculation, total time' when 'hash_calculation' then 'Hash calculation'
  when 'database_insert' then 'Database insert' when 'database_query' then 'Database query'
  when 'file_move_total' then 'File move, total time' when 'file_move' then 'File move'
  when 'directory_creation' then 'Directory creation' when 'permission_copy' then 'Permission copy'
  when 'file_delete' then 'Source file removal' when 'file_processing_total' then 'File processing, total time'
  when 'conflict_check' then 'Name conflict check' when 'file_info' then 'File information' when 'file_open' then 'File open'
  when 'path_generation' then 'Path generation' else operation end as name"""


def log_sql() -> dict[str, str]:
    """Log analytics and file events."""
    sample = "operation, round(time_ms, 6) as time_ms, size_mb, speed_mbps, filename"
    total = "operation, round(total_ms, 3) as total_ms, round(avg_ms, 6) as avg_ms, count"
    latency = """operation, count(*) as count, round(avg(time_ms), 6) as avg_ms, round(median(time_ms), 6) as median_ms,
        round(min(time_ms), 6) as min_ms, round(max(time_ms), 6) as max_ms, round(stddev_samp(time_ms), 4) as stddev_ms"""
    out = {
        "read_log": "select level, count(*) as lines from log group by level",
        "classify_operations": f"select {sample} from samples",
        "classify_operations_strict": f"select {sample} from samples where event_type = 'view' or event_type = 'click'",
        "classify_operations_extra": f"select {sample} from all_samples where operation is not null",
        "queue_warnings": "select ts, concat('/src/', user_id, '.jpg') as file_name from log where number = 18",
        "warning_count": "select count(*) as warnings from log where number = 18",
        "first_warnings": """select ts, concat('/src/', user_id, '.jpg') as file_name from log where number = 18
            order by ts, concat('worker.go:', user_id, ' ') limit 5""",
        "filter_log_level": "select ts, level from log where level in ('WARN', 'ERROR')",
        "slow_operations": """select operation, round(time_ms, 6) as time_ms from all_samples
            where (operation = 'database_query' and time_ms > 100) or (operation = 'batch_insert' and time_ms > 1000)""",
        "worker_counts": "select user_id as worker_id, cast(sum(cast(trunc(value) as bigint)) as bigint) as files from log where number = 19 group by 1",
        "latency_stats": f"select {latency} from samples group by operation",
        "transfer_stats": """select operation, round(avg(speed_mbps), 6) as avg_speed_mbps, round(avg(size_mb), 3) as avg_size_mb
            from samples where operation in ('file_copy_detail', 'hash_calculation_detail') group by operation""",
        "operation_totals": f"select {total} from totals",
        "performance_report": "select operation, round(avg_ms, 6) as avg_ms, count from totals",
        "top_by_total_time": f"select {total} from totals order by totals.total_ms desc, operation limit 10",
        "top_by_avg_time": f"select {total} from totals order by totals.avg_ms desc, operation limit 10",
        "top_bottleneck": f"select {total} from totals order by totals.total_ms desc, operation limit 1",
        "operation_names": f"""select operation, {NAME}, count(*) as samples from all_samples where operation is not null group by 1""",
        "analyze_log": f"select {NAME}, * from (select {latency} from samples group by operation)",
        "file_event_stream": "select path, op, ts from file_events",
        "filter_events": "select path, op, ts from file_events where op in ('CREATE', 'WRITE')",
        "debounce_events": "select path, events, first_ts, last_ts, last_op from sessions",
        "debounce_stream": "select path, events, first_ts, last_ts, last_op from sessions",
        "drop_vanished": "select path, events, first_ts, last_ts, last_op from sessions where last_op <> 'REMOVE'",
    }
    out["recommendations"] = f"""
        select 1 as section, cast(unnest(range(len(texts))) as int) as place, unnest(texts) as advice from (
          select list_concat([printf('%s takes the most time: %.2f ms', name, total_ms)],
            case when operation like '%detail%' then ['one', 'two'] when operation like '%total%' then ['three']
              when operation like '%file%' then ['four'] when operation like '%o%' then ['five'] else [] end) as texts
          from (select *, {NAME} from totals order by totals.total_ms desc, operation limit 1))
        union all select 2, cast(unnest(range(2)) as int), unnest(['six', 'seven'])
        union all select 3, 0, 'eight' where exists (select 1 from log where number = 18)"""
    out["flush_sizes"] = """
        select cast(row_number() over (order by first_ts) as bigint) as flush, if(rows = 50, 'rows', 'quiet') as reason, * from (
          select count(*) as rows, min(ts) as first_ts, max(ts) as last_ts from (
            select ts, stretch, (row_number() over (partition by stretch order by ts) - 1) // 50 as k from (
              select ts, sum(starts) over (order by ts, event_id) as stretch from (
                select event_id, ts, if(ts - lag(ts) over (order by ts, event_id) > interval 10 minutes, 1, 0) as starts from events)))
          group by stretch, k)"""
    out["watch_ingest"] = """
        select 'let through' as what, concat('/src/', source, '/', doc_id // 100, '/doc_', doc_id, '.EN') as path, hash
          from files where doc_id % 10 <> 7
        union all select distinct 'recorded', null, hash from files where doc_id % 10 <> 7"""
    out["write_report"] = """
        select 'latency' as report, operation, count(*) as n, round(median(time_ms), 6) as value from samples group by operation
        union all select 'transfer', operation, null, round(avg(speed_mbps), 6) from samples
          where operation in ('file_copy_detail', 'hash_calculation_detail') group by operation
        union all (select 'top_by_total_time', operation, count, round(total_ms, 3) from totals order by totals.total_ms desc, operation limit 10)
        union all (select 'top_by_avg_time', operation, count, round(avg_ms, 6) from totals order by totals.avg_ms desc, operation limit 10)
        union all select 'warning_count', null, count(*), null from log where number = 18
        union all (select 'first_warnings', null, 1, null from log where number = 18 limit 5)"""
    out = {name: over(sql) for name, sql in out.items()}
    out["late_event_policy"] = LATE
    return out


#: Every fiftieth event comes three tenths late. The watermark is in milliseconds, a tenth behind.
LATE = """
with arrivals as (
  select event_id, concat('/src/', user_id, '.jpg') as path, ts,
    case event_type when 'click' then 'CREATE' when 'error' then 'REMOVE' else 'WRITE' end as op,
    least(9, event_id * 10 // (select count(*) from events) + if(event_id % 50 = 0, 3, 0)) as part
  from events),
parts as (select part, max(ts) as newest from arrivals group by part),
marks as (
  select part, date_trunc('milliseconds', max(newest) over (order by part rows between unbounded preceding and 1 preceding))
    - interval 10 minutes as mark from parts),
judged as (select a.*, mark, coalesce(ts + interval 30 minutes <= mark, false) as late from arrivals a join marks using (part)),
timely as (
  select *, sum(starts) over (partition by path order by ts, op) as burst from (
    select *, if(ts - lag(ts) over (partition by path order by ts, op) > interval 30 minutes, 1, 0) as starts
    from judged where not late))
select path, count(*) as events, min(ts) as first_ts, max(ts) as last_ts, max_by(op, (ts, op)) as last_op,
  cast(null as timestamp) as watermark from timely group by path, burst
union all select path, 0, ts, ts, op, mark from judged where late
"""


def oracle_sql() -> dict[str, str]:
    return catalog_sql() | function_sql() | log_sql()
