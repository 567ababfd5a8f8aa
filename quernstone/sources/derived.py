"""An estate written from relational tables: a program per supplier, a copybook per nation, a job per customer.

Every member is text made by Spark expressions, so the estate grows with the tables and each fact that parsing it should
give is known from the tables alone. The numbers stand for: i the supplier, n its nation, r its region, N the number of
suppliers; a program calls that of supplier ``(7 i + 3) mod N``; a step runs the program of ``order mod N``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.session import table

PROGRAM = """\
       IDENTIFICATION DIVISION.
       PROGRAM-ID. {p}.
       ENVIRONMENT DIVISION.
       INPUT-OUTPUT SECTION.
       FILE-CONTROL.
           SELECT IN-FILE ASSIGN TO UT-S-DDIN.
           SELECT OUT-FILE ASSIGN TO DDOUT.
       DATA DIVISION.
       FILE SECTION.
       FD IN-FILE.
       01 IN-REC.
          05 IN-KEY PIC X(10).
          05 IN-AMT PIC S9(7)V99 COMP-3.
       FD OUT-FILE.
       01 OUT-REC.
       COPY NAT{nn}.
       WORKING-STORAGE SECTION.
       01 WS-AREA.
          05 WS-KEY PIC X(10).
          05 WS-AMT PIC S9(7)V99 COMP-3.
          05 WS-STATE PIC X(1).
             88 STATE-ODD VALUE 'O'.
             88 STATE-EVEN VALUE 'E'.
       01 WS-PGM PIC X(8) VALUE '{callee}'.
       01 HV-BAL PIC S9(9) COMP.
       01 WS-COPY.
          05 IN-KEY PIC X(10).
          05 WS-ROW OCCURS 3 PIC X(4).
       LINKAGE SECTION.
       01 LK-KEY PIC X(10).
       01 LK-BAL PIC S9(9) COMP.
       PROCEDURE DIVISION USING LK-KEY LK-BAL.
       MAIN-PARA.
           OPEN INPUT IN-FILE.
           OPEN OUTPUT OUT-FILE.
           PERFORM READ-PARA THRU READ-EXIT.
           MOVE '{state}' TO WS-STATE.
           IF WS-STATE = 'Q' DISPLAY 'BAD STATE ' WS-STATE.
           EXEC SQL SELECT BAL INTO :HV-BAL FROM APP.TAB{r}
             WHERE ID = :WS-KEY END-EXEC.
           CALL {call} USING WS-KEY HV-BAL.
{gone}           GOBACK.
       READ-PARA.
           READ IN-FILE INTO WS-AREA.
           MOVE IN-KEY OF IN-REC TO NAT-KEY.
           MOVE CORR IN-REC TO WS-COPY.
           MOVE LK-KEY(1:4) TO WS-ROW(2).
           WRITE OUT-REC.
       READ-EXIT.
           EXIT.
       UPD-PARA.
           EXEC SQL UPDATE APP.TAB{r1} SET BAL = :LK-BAL
             WHERE ID = :LK-KEY END-EXEC.
       CUR-PARA.
           EXEC SQL DECLARE C1 CURSOR FOR SELECT ID, BAL
             FROM APP.TAB{r} END-EXEC.
           EXEC SQL FETCH C1 INTO :WS-KEY, :HV-BAL END-EXEC.
           EXEC CICS WRITEQ TS QUEUE('Q{r}') FROM(WS-KEY) END-EXEC.
           EXEC CICS READQ TS QUEUE('Q{r1}') INTO(WS-COPY) END-EXEC.
       LOST-PARA.
           MOVE WS-AMT TO IN-AMT.
           MOVE IN-KEY TO WS-KEY.
           INITIALIZE WS-COPY.
"""
COPYBOOK = """\
          05 NAT-KEY PIC X({key}).
          05 NAT-NAME PIC X({name}).
          05 NAT-ALT REDEFINES NAT-NAME PIC 9(3).
          05 NAT-CNT OCCURS {times} PIC 9(4) COMP.
          05 NAT-AMT PIC S9({digits})V99 COMP-3.
"""
TEST_COPYBOOK = """\
          05 NAT-KEY PIC X(12).
          05 NAT-NAME PIC X({name}).
          05 NAT-NEW PIC 9(5).
"""
PROCEDURE = """\
//PRC{r}     PROC ENV=TEST
//STEP1    EXEC PGM=P000000{r}
//DDIN     DD DSN=&ENV..MASTER{r},DISP=SHR
//         DD DSN=&ENV..EXTRA{r},DISP=SHR
//DDOUT    DD DSN=&ENV..PRCOUT,DISP=(NEW,CATLG)
//STEP2    EXEC PGM=IEFBR14
//DDKEEP   DD DSN=&ENV..KEEP{r}(0),DISP=SHR
"""
INCLUDE = "//INCSTEP  EXEC PGM=IEFBR14\n//DDINC    DD DSN=INC.R{r},DISP=SHR\n"
UTILITIES = """\
//UTIL{r}    JOB (ACCT),'U'
//         JCLLIB ORDER=(LIB.A{r},LIB.B)
//SORT1    EXEC PGM=SORT
//SORTIN   DD DSN=PROD.MASTER{r},DISP=SHR
//SORTOUT  DD DSN=PROD.SORTED{r},DISP=(NEW,CATLG)
//SYSIN    DD DSN=PROD.CTL(SRT{r}),DISP=SHR
//COPY1    EXEC PGM=IEBGENER
//SYSUT1   DD DSN=PROD.SORTED{r},DISP=SHR
//SYSUT2   DD DSN=PROD.COPIED{r},DISP=(NEW,CATLG)
//SYSIN    DD DUMMY
//REBUILD  EXEC PGM=SORT
//SORTIN   DD DSN=PROD.COPIED{r},DISP=SHR
//SORTOUT  DD DSN=PROD.REBUILT{r},DISP=(NEW,CATLG)
//SYSIN    DD *
  SORT FIELDS=(1,4,CH,A)
  OUTREC BUILD=(1,10,11:20,5)
/*
//DEFINE   EXEC PGM=IDCAMS
//SYSIN    DD *
  DELETE PROD.KSDS{r} CLUSTER
  DEFINE CLUSTER (NAME(PROD.KSDS{r}) -
    INDEXED KEYS({key} 0) -
    RECORDSIZE(80 {most}))
  DEFINE GDG (NAME(PROD.GDG{r}) LIMIT({limit}))
  REPRO INDATASET(PROD.COPIED{r}) -
    OUTDATASET(PROD.REPRO{r})
  REPRO INDATASET(PROD.REPRO{r}) OUTDATASET(PROD.LAST{r})
/*
//LOAD     EXEC PGM=DSNUTILB,PARM='DB2P,LOAD'
//SYSREC   DD DSN=PROD.LOAD{r},DISP=SHR
//SYSIN    DD *
  LOAD DATA INDDN SYSREC RESUME YES INTO TABLE APP.TAB{r}
/*
//REPORT   EXEC PGM=EZTPA00
//EZTIN    DD DSN=PROD.MASTER{r},DISP=SHR
//SYSIN    DD *
FILE EZTIN
 REC-KEY 1 {key} A
 REC-AMT 11 5 P
JOB INPUT EZTIN
/*
//RUN      EXEC PGM=IKJEFT01
//DDIN     DD DSN=PROD.COPIED{r},DISP=SHR
//DDOUT    DD DSN=PROD.GDG{r}(+1),DISP=(NEW,CATLG)
//SYSTSIN  DD *
  DSN SYSTEM(DB2P)
  RUN PROGRAM(P000000{r}) PLAN(PL{r})
/*
//BATCH    EXEC IMSBATCH,MBR=P000000{r},PSB=PSB{r}
//XFER     EXEC PGM=FTP
//INPUT    DD *
  host.example
  someone secret{r}
  GET A B
/*
//PARMS    EXEC PGM=P000000{r}
//SYSIN    DD *
RUN-MODE=R{r}
/*
//LOST     EXEC NOPROC{r}
"""
SORT_CARDS = "  SORT FIELDS=(1,{key},CH,A)\n  INCLUDE COND=(11,2,CH,EQ,C'OK')\n"
DATABASE = """\
         DBD   NAME=DB{r},ACCESS=HDAM
         SEGM  NAME=SEG{r},PARENT=0,BYTES=15
         FIELD NAME=(KEY{r},SEQ,U),BYTES=10,START=1
         FIELD NAME=AMT{r},BYTES=5,START=11
"""
VIEW = """\
         PCB   TYPE=DB,DBDNAME=DB{r},PROCOPT=A
         SENSEG NAME=SEG{r}
         PSBGEN PSBNAME=PSB{r},CMPAT={cmpat}
"""
MAP = """\
MAPS{r}    DFHMSD TYPE=MAP
MAP{r}     DFHMDI SIZE=(24,80)
WS-KEY   DFHMDF POS=({row},10),LENGTH=10
"""
GUIDE = "Region {r} writes PROD.MASTER{r} each night.\n\nSee the reports of region {r}.\n"
TRANSACTION = "DEFINE TRANSACTION(T{nn}) GROUP(G) PROGRAM({p})\n"


def _filled(template: str, **values: Column | str) -> Column:
    """The template with columns in the places of its names."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), (F.lit(value) if isinstance(value, str) else value).cast("string"))
    return out


def _padded(number: Column, width: int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def program_of(supplier: Column) -> Column:
    return F.concat(F.lit("P"), _padded(supplier, 7))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): all members as files below /estate."""
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("r"))
    supplier = table(spark, sf_dir, "supplier")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q"), "l_linestatus")
    many = supplier.count()
    own = nation.select("n_nationkey", "n_name", F.col("n_regionkey").alias("r"))

    def member(df: DataFrame, folder: Column, name: Column, suffix: str, text: Column) -> DataFrame:
        return df.select(F.concat(F.lit("/estate/"), folder, F.lit("/"), name, F.lit(f".{suffix}")).alias("path"), F.encode(text, "UTF-8").alias("content"))

    in_region = lambda library: F.concat(F.lit("R"), F.col("r"), F.lit(f"/{library}"))
    i, nn = F.col("s_suppkey"), _padded(F.col("n_nationkey"), 2)
    callee = program_of((i * 7 + 3) % many)
    # a small table is read by one task, but a text of each row is work for many
    programs = supplier.repartition(-(-many // 2000) or 1, "s_suppkey").join(F.broadcast(own), F.col("s_nationkey") == F.col("n_nationkey"))
    out = member(
        programs, in_region("SRC"), program_of(i), "cbl",
        _filled(PROGRAM, p=program_of(i), nn=nn, callee=callee, r=F.col("r"), r1=(F.col("r") + 1) % 5, state=F.when(i % 10 == 0, "X").when(i % 2 == 1, "O").otherwise("E"),
                call=F.when(i % 2 == 0, "WS-PGM").otherwise(F.concat(F.lit("'"), callee, F.lit("'"))), gone=F.when(i % 10 == 0, F.concat(F.lit("           CALL 'GONE"), F.col("r"), F.lit("'.\n"))).otherwise("")),
    )
    name = F.concat(F.lit("NAT"), nn)
    key = 10 + F.col("n_nationkey") % 3
    parts = [
        member(own, in_region("COPYLIB"), name, "cpy", _filled(COPYBOOK, key=key, name=F.length("n_name"), times=F.col("r") + 1, digits=F.col("n_nationkey") % 7 + 1)),
        member(own.filter("n_nationkey % 2 = 0"), F.lit("TEST/COPYLIB"), name, "cpy", _filled(TEST_COPYBOOK, name=F.length("n_name"))),
        member(own, in_region("CSD"), F.concat(F.lit("TRN"), nn), "csd", _filled(TRANSACTION, nn=nn, p=program_of(F.col("n_nationkey") % many))),
        member(region, in_region("PROCLIB"), F.concat(F.lit("PRC"), "r"), "prc", _filled(PROCEDURE, r=F.col("r"))),
        member(region, in_region("PROCLIB"), F.concat(F.lit("INC"), "r"), "inc", _filled(INCLUDE, r=F.col("r"))),
        member(region, in_region("CNTL"), F.concat(F.lit("SRT"), "r"), "ctl", _filled(SORT_CARDS, key=F.col("r") + 8)),
        member(region, in_region("JCLLIB"), F.concat(F.lit("UTIL"), "r"), "jcl", _filled(UTILITIES, r=F.col("r"), key=F.col("r") + 8, most=F.col("r") + 100, limit=F.col("r") + 3)),
        member(region, in_region("DBDLIB"), F.concat(F.lit("DB"), "r"), "dbd", _filled(DATABASE, r=F.col("r"))),
        member(region, in_region("PSBLIB"), F.concat(F.lit("PSB"), "r"), "psb", _filled(VIEW, r=F.col("r"), cmpat=F.when(F.col("r") % 2 == 0, "YES").otherwise("NO"))),
        member(region, in_region("DOCS"), F.concat(F.lit("GUIDE"), "r"), "txt", _filled(GUIDE, r=F.col("r"))),
        member(region, in_region("MAPS"), F.concat(F.lit("MAP"), "r"), "bms", _filled(MAP, r=F.col("r"), row=F.col("r") + 1)),
    ]
    # data sets of a step: lines of status O are read, the others written; in a fixed order
    dsn = F.concat(F.lit("DSN=&HLQ..D"), "l_partkey", F.lit(".V"), "q")
    row = F.struct((F.col("l_linestatus") != "O").alias("late"), "l_linenumber", "l_partkey", "q", dsn.alias("dsn"))
    steps = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_orderkey", "o_custkey", "o_orderstatus").agg(F.sort_array(F.collect_list(F.when(F.col("l_orderkey").isNotNull(), row))).alias("rows"))

    def dds(late: bool) -> Column:
        mine = F.filter("rows", lambda x: x["late"] == late)
        dd, disp = ("DDOUT", "(NEW,CATLG)") if late else ("DDIN", "SHR")
        each = F.transform(mine, lambda x, k: F.concat(F.when(k == 0, f"//{dd:<8} DD ").otherwise("//         DD "), x["dsn"], F.lit(f",DISP={disp}\n")))
        return F.array_join(each, "")

    guarded = F.col("o_orderstatus") == "P"
    step = F.concat(F.when(guarded, "//         IF (RC = 0) THEN\n").otherwise(""), F.lit("//S"), _padded(F.col("o_orderkey"), 7), F.lit(" EXEC PGM="), program_of(F.col("o_orderkey") % many), F.lit("\n"), dds(False), dds(True), F.when(guarded, "//         ENDIF\n").otherwise(""))
    by_job = steps.select("o_custkey", F.struct("o_orderkey", step.alias("text")).alias("s")).groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["text"]), "").alias("steps"))
    jobs = customer.join(F.broadcast(own), F.col("c_nationkey") == F.col("n_nationkey")).join(by_job, F.col("c_custkey") == F.col("o_custkey"), "left")
    job = F.concat(F.lit("C"), _padded(F.col("c_custkey"), 7))
    text = F.concat(
        F.lit("//"), job, F.lit(" JOB (ACCT),'X'\n//         SET HLQ=PROD\n//         INCLUDE MEMBER=INC"), "r", F.lit("\n//RUN      EXEC PRC"), "r", F.lit(",ENV=&HLQ\n//STEP1.DDOUT DD DSN=PROD.SEG."), F.substring("c_mktsegment", 1, 8), F.lit("\n"),
        F.coalesce("steps", F.lit("")),
    )
    parts.append(member(jobs, in_region("JCLLIB"), job, "jcl", text))
    for more in parts:
        out = out.unionByName(more)
    return out
